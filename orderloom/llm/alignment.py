"""Two tokenizers aligned: which tokens of the one cover the bytes of which tokens of the other, and how usual that is.

The ends of the tokens, counted in bytes, go into a dictionary from end to index for each tokenizer; ends that both
dictionaries have, sorted, cut the two lists into groups, and inside a group every token is linked to those it overlaps.
A blank between two characters that are no white space starts a new token of either tokenizer whatever stands before
it, so its stretch is aligned alone, once for each time a worker process meets it anew, and a text is put together from
its stretches. Where a vocabulary does not cut that way, a text is one stretch.

How often two ids are linked in the whole corpus is a Spark aggregate over the documents' distinct pairs. The documents
get these counts back in two ways: the most frequent pairs, a bounded number, are broadcast; all others are joined.

Edge cases: texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens and give
zeros; special tokens' strings are plain text; very long texts are read whole, a stretch without blanks as well; ties
of the highest count are all best; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, texts

#: Stretches whose ids a task keeps, code points of the longest one that is kept, pairs that are broadcast at most.
KEPT, KEPT_LENGTH = 400_000, 40
HEAD = 1 << 18
#: Finer steps in which the least count of a broadcast pair is looked for: 8 to each doubling.
STEPS = 8
_CUT = re.compile(r" (?=\S)(?<=\S )")


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def _byte_level(vocabulary: str, ranks: str | None) -> tuple[Callable[[str], list[int] | np.ndarray], list[bytes], bool]:
    """Encoder without special tokens, the bytes of every id, and whether these always join to the text again.

    The ranks file holds the same vocabulary for a faster encoder. Its pattern takes every character of a text, so with all
    256 bytes among the ranks nothing is lost; where that is not known the bytes are joined and compared.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    exact.encode_special_tokens = True
    signs = _byte_of_sign()
    spelled = [b""] * exact.get_vocab_size()
    for token, number in exact.get_vocab().items():
        spelled[number] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    if ranks is None:
        return lambda text: exact.encode(text, add_special_tokens=False).ids, spelled, False
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int] | np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except ValueError:  # its pattern matcher gives up on endless runs of blanks
            return exact.encode(text, add_special_tokens=False).ids

    return encode, spelled, all(bytes([i]) in table for i in range(256))


def _words_alone(vocabulary: str) -> bool:
    """Whether the vocabulary file cuts a text into words before it merges, so that a blank before a word begins a token."""
    with open(vocabulary, encoding="utf-8") as file:
        settings = json.load(file)
    cut = settings.get("pre_tokenizer") or {}
    return settings.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)


@lru_cache(maxsize=2)
def _pieces(model: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes], bool]:
    """Encoder of many texts, the bytes of every id, and whether no piece goes on after a blank, so that stretches can be encoded alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    alone = not any(re.search("[^▁]▁", p) for p in names)
    return lambda parts: sp.encode(parts, num_threads=1), spelled, alone


class Aligner:
    """Aligns texts stretch by stretch; the last stretches met are kept with all that a text needs of them.

    Both tokenizers start anew at a stretch, so its end is an end of both, its groups are whole groups of the text and no
    link leaves it. A record holds n_a, n_b, n_groups, n_links, the groups written out, and the links as 64-bit numbers.
    """

    def __init__(self, vocabulary: str, ranks: str | None, model: str):
        self.encode_a, self.bytes_a, self.whole = _byte_level(vocabulary, ranks)
        self.encode_pieces, self.bytes_b, alone = _pieces(model)
        self.alone = alone and _words_alone(vocabulary)
        self.length_a, self.length_b = (np.array([len(t) for t in spelled], np.int64) for spelled in (self.bytes_a, self.bytes_b))
        self.size_b = len(self.bytes_b)
        # an id as it is written inside a list and at its end, ids of b after those of a
        self.written = [b"%d%s" % (i, sign) for n, signs in ((len(self.bytes_a), (b",", b"|")), (self.size_b, (b",", b";"))) for i in range(n) for sign in signs]
        self.kept: dict[str, tuple] = {}

    def groups(self, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shared ends cut the lists of a and of b: for each group the index after its last token."""
        index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
        index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
        shared = sorted(index_a.keys() & index_b.keys())
        return np.array([index_a[e] for e in shared]), np.array([index_b[e] for e in shared])

    def in_order(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[bytes]:
        """The groups written out, id by id: each group's slice of a, then its slice of b."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], cut_b))[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + cut_a[group_b]] = 2 * (len(self.bytes_a) + b) + last_b
        return [self.written[i] for i in order.tolist()]

    def learn(self, parts: list[str]) -> None:
        """Keep the records of new stretches, aligned as one text; an empty one where a tokenizer does not spell a stretch."""
        joined = " " + " ".join(parts)
        data = joined.encode()
        a, b = np.asarray(self.encode_a(joined), np.int64), self.encode_pieces([joined[1:]])[0]
        if b"".join([self.bytes_b[i] for i in b]) != data or not self.whole and b"".join([self.bytes_a[i] for i in a.tolist()]) != data:
            half = len(parts) // 2
            if half:
                self.learn(parts[:half])
                self.learn(parts[half:])
            else:
                self.kept[parts[0]] = ()
            return
        b = np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cut_a, cut_b = self.groups(ends_a, ends_b)
        # within a slice, the bytes between two neighbouring ends of either list belong to one token of each: a link
        ends = np.union1d(ends_a, ends_b)
        links = (a[np.searchsorted(ends_a, ends)] * self.size_b + b[np.searchsorted(ends_b, ends)]).tobytes()
        ids = self.in_order(a, b, cut_a, cut_b)
        stops = np.cumsum([len(p.encode()) + 1 for p in parts]) if len(parts) > 1 else np.array([len(data)])
        until = np.array([np.searchsorted(e, stops, "right") for e in (ends_a, ends_b, ends_a[cut_a - 1], ends)])
        counts = np.diff(until, prepend=0, axis=1).tolist()
        i = j = 0
        for p, at, link, *n in zip(parts, (until[0] + until[1]).tolist(), (8 * until[3]).tolist(), *counts):
            self.kept[p] = (*n, b"".join(ids[i:at])[:-1], links[j:link])
            i, j = at, link

    def text(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, hash of the groups, distinct linked pairs (a * size_b + b) and how often each."""
        nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not text:
            return nothing
        parts = _CUT.split(text) if self.alone else [text]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = set(parts).difference(self.kept)
        # the first and the last stretch of a text may begin or end with white space, then they do not stand beside others
        alone = new.intersection(p for p in (parts[0], parts[-1]) if not p or p[0].isspace() or p[-1].isspace() or not self.alone)
        for p in alone:
            self.learn([p])
        if len(new) > len(alone):
            self.learn(list(new - alone))
        found = [self.kept[p] for p in parts]
        for p in new:
            if len(p) > KEPT_LENGTH:
                del self.kept[p]
        if not all(found):
            return nothing
        n_a, n_b, n_groups, n_links, written, links = zip(*found)
        pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
        return sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(b";".join(written)).hexdigest(), pairs, times


@lru_cache(maxsize=1)
def _aligner(vocabulary: str, ranks: str | None, model: str) -> Aligner:
    """One for a worker process, which goes on to its next task."""
    return Aligner(vocabulary, ranks, model)


def linked_pairs(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None) -> DataFrame:
    """One row for each document: `row` (doc_id), its counts, groups_sha256, and its distinct linked pairs with their times."""
    schema = ("row struct<doc_id:bigint>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "pairs array<bigint>, times array<int>")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(vocabulary, ranks, model)
        for batch in batches:
            out, held = [], 0
            for row, text in zip(batch["row"], batch["text"]):
                got = aligner.text(text)
                out.append((row, *got))
                held += len(got[5])
                if held > 1_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    rows = texts(docs).select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id")).alias("row"), "text")
    return rows.mapInPandas(run, schema)


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """pair, count over the corpus, and best: whether no pair with the same id of b has a higher count."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"))
    same_b = Window.partitionBy(F.col("pair") % size_b)  # at most as many rows as a has ids
    return counts.withColumn("best", F.col("count") == F.max("count").over(same_b))


def _least_count(counts: DataFrame, head: int) -> int:
    """The least count from which on there are at most `head` pairs."""
    step = F.floor(F.log2("count") * STEPS).alias("step")
    above = 0
    for r in sorted(counts.groupBy(step).agg(F.count("*").alias("n"), F.max("count").alias("high")).collect(), reverse=True):
        above += r["n"]
        if above > head:
            return r["high"] + 1
    return 0


def align(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best counts the links of a pair that is the most frequent one of its id of b; count_sum adds up the pairs' counts.
    """
    size_b = len(_pieces(model)[1])
    linked = cut_lineage(linked_pairs(docs, vocabulary, model, ranks).withColumn("key", F.monotonically_increasing_id()), "alignment-pairs")
    counts = cut_lineage(pair_counts(linked, size_b), "alignment-counts")
    least = _least_count(counts, head)
    usual = counts.where(F.col("count") >= least).toPandas().sort_values("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(usual[c].to_numpy(t) for c, t in (("pair", np.int64), ("count", np.int64), ("best", np.int64))))
    del usual

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, count, best = sent.value
        for batch in batches:
            out = []
            for mine, times in zip(batch.pop("pairs"), batch.pop("times")):
                mine, times = np.asarray(mine, np.int64), np.asarray(times, np.int64)
                at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
                hit = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
                at = at[hit]
                out.append((int((best[at] * times[hit]).sum()) if len(at) else 0, int((count[at] * times[hit]).sum()) if len(at) else 0, mine[~hit], times[~hit]))
            more = pd.DataFrame(out, columns=["n_best", "count_sum", "rare", "times"], index=batch.index)
            yield pd.concat([batch, more], axis=1)

    kept = "row struct<doc_id:bigint>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, key bigint"
    known = cut_lineage(linked.select("row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "key", "pairs", "times")
                        .mapInPandas(add_up, f"{kept}, n_best bigint, count_sum bigint, rare array<bigint>, times array<int>"), "alignment-known")
    sent.destroy()
    rest = known.select("key", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("key", F.col("p.rare").alias("pair"), F.col("p.times").alias("times"))
    rare = counts.where(F.col("count") < least)
    more = rest.join(rare, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_count"))
    return known.join(more, "key", "left").select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"), "groups_sha256")
