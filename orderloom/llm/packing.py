"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Documents become token ids with an end id; longer ones are cut into full pieces, of which the first may be shorter.
Best fit decreasing only looks at lengths, and there are no more lengths than tokens in a sequence. So Spark counts the
pieces of each length, the placement runs over (length, count) with a segment tree over remaining capacities, in bulk
for equal pieces, and Spark numbers the pieces within each length and looks their places up. What the driver holds is
bounded by the sequence length, not by the data.

Edge cases: a null text is empty, so its document is the end id alone; very long texts give many pieces; repeated rows
are packed once each; equal lengths are numbered by a hash of their key, then by the key; an empty table packs nothing.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, texts

SIZE = 2048
END_ID = 0
#: Rows numbered by one task within one length, about.
NUMBERED = 2_000


@lru_cache(maxsize=4)
def _exact(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, ranks: str | None):
    """A function from text to ids. The ranks file holds the same vocabulary for a faster encoder with the same ids."""
    if ranks is None:
        return lambda text: _exact(vocabulary).encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(table)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # its pattern matcher gives up on endless runs of blanks
            return _exact(vocabulary).encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary, ranks)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text), end_id], "<u4")
                first = len(ids) % size or size
                edges = [0, *range(min(first, len(ids)), len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[a:b]
                    out.append((doc_id, piece, a, b - a, zlib.crc32(part.tobytes())) + ((part.astype("i4"),) if with_ids else ()))
                held += len(ids)
                if len(out) >= 20_000 or held >= 4_000_000:
                    yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return texts(docs).mapInPandas(cut, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: the tightest capacity of at least s that has open bins, in logarithmic time."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.width
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.width
        if self.open[at]:
            return least
        while at > 1:  # climb to the first right neighbour that has open bins, then descend to its leftmost
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def placement(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over (length, count): rows (length, first number, how many, first bin, offset).

    Equal pieces are placed in bulk: while one capacity is the tightest, piece after piece fills a bin of it before the
    next bin, which is what placing them one by one does.
    """
    tree, bins, rows = CapacityTree(size), {}, []
    last = 0
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, there = size, last, -(-left // (size // length))
                last += there
            else:
                first, there = bins[capacity].pop()
                tree.add(capacity, -there)
            layers = capacity // length
            full, rest = min(there, left // layers), 0
            if full < there:
                rest = left - full * layers
            for layer in range(layers):
                many = full + (layer < rest)
                if many:
                    rows.append((length, number, many, first, size - capacity + layer * length))
                    number, left = number + many, left - many
            for start, many, used in ((first, full, layers), (first + full, 1 if rest else 0, rest), (first + full + bool(rest), there - full - bool(rest), 0)):
                remains = capacity - used * length
                if many and remains:
                    bins.setdefault(remains, []).append((start, many))
                    tree.add(remains, many)
    return rows


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, vocabulary, ranks, size, end_id, with_ids), "pieces")
    counts = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    rows = np.array(placement(counts, size), "i8").reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    plan = spark.sparkContext.broadcast(rows)  # bounded by the number of lengths, not of pieces

    blocks = max(1, sum(counts.values()) // NUMBERED)
    keyed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = (keyed.groupBy("length", "block").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (keyed.withColumn("k", F.row_number().over(within)).join(before, ["length", "block"])
                .withColumn("number", F.col("before") + F.col("k") - 1))

    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        table = plan.value
        sizes, edges = np.unique(table[:, 0], return_index=True)
        edges = np.append(edges, len(table))
        row = np.empty(len(length), "i8")
        for i in np.unique(np.searchsorted(sizes, length.to_numpy())):
            mine = length.to_numpy() == sizes[i]
            row[mine] = edges[i] + np.searchsorted(table[edges[i]:edges[i + 1], 1], number.to_numpy()[mine], "right") - 1
        hit = table[row]
        return pd.DataFrame({"sequence_id": hit[:, 3] + number.to_numpy() - hit[:, 1], "offset": hit[:, 4]})

    placed = F.pandas_udf(place, "sequence_id bigint, offset bigint")
    return numbered.withColumn("p", placed("length", "number")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"), *["ids"] * with_ids)
