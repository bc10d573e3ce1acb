"""Exact substring dedup: every byte that a long enough repeated string covers goes.

Method: suffixes are sorted by a distributed merge sort that knows common prefixes. Tasks sort their suffixes into
front-coded runs (length shared with the line before, then the rest), runs are exchanged by ranges, and a loser tree
merges them: each line carries the length it shares with the last one put out, so no known prefix is compared again,
and the merge gives the shared lengths of the sorted order, from which repeats are read.

Only suffixes that matter are sorted. In every string of `length` bytes one gram of `gram` bytes, the one with the least
hash, is its anchor; equal strings have equal anchors at equal places. Starts with the same anchor form a run, and runs
whose gram stands nowhere else hold no repeat. Where all runs of a gram have the same bytes from their first start to
their last string's end, all of their starts repeat. What is left, near the borders of repeated passages, is sorted:
each distinct run's text from the anchor on, with its text before the anchor alongside. A start d bytes before the anchor
repeats if another run shares d bytes before and length - d bytes from the anchor on.

A gram with more distinct runs than GROUP is not merged in one task: each of its starts' strings is counted by its
digest instead, which gives the same result and splits evenly.

Edge cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; very long texts are worked
in chunks; a repeated row is a document of its own, so its whole text repeats; strings may overlap themselves; bytes that
are no whole character may go; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, cut_lineage

LENGTH, GRAM = 200, 64
#: Grams worked at a time (their places share a number with the hash), distinct runs of a gram that one task merges at most, lines in a range, lines sampled for its borders.
CHUNK, GROUP, LINES, SAMPLE = 1 << 20, 4_000, 20_000, 20_000
_BASE = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` bytes, by doubling widths."""
    with np.errstate(over="ignore"):
        power, base, done, size = np.uint64(_BASE), data.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9), None, 1
        held = 0
        while True:
            if width & size:
                if done is None:
                    done = base
                else:
                    n = min(len(done), max(len(base) - held, 0))
                    done = done[:n] * power + base[held:held + n]
                held += size
            if 2 * size > width:
                break
            n = max(len(base) - size, 0)
            base, power, size = base[:n] * power + base[size:size + n], power * power, 2 * size
        done = done ^ (done >> np.uint64(31))
        done = done * np.uint64(0xBF58476D1CE4E5B9)
        return done ^ (done >> np.uint64(29))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, starts, distance of the anchor from the first start, gram hash) of every run of one text.

    The anchor of a string is its gram with the least upper 44 bits of the hash, the first of equal ones: it depends on the
    string's bytes alone.
    """
    total, out = len(data) - length + 1, []
    room = CHUNK - (length - gram)
    for at in range(0, max(total, 0), room):
        many = min(room, total - at)
        grams = rolling(np.frombuffer(data, np.uint8, many + length - 1, at), gram)
        keys = (grams & ~np.uint64(CHUNK - 1)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (window_least(keys, length - gram + 1) & np.uint64(CHUNK - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        out.append((at + first, np.diff(np.append(first, many)), anchor[first] - first, grams[anchor[first]].view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _rows(docs: DataFrame) -> DataFrame:
    """Texts as bytes under a key that tells different rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("data"))


def _all_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def table(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("id", "h", "first", "starts", "anchor", "g", "t"), map(np.concatenate, zip(*parts)))))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for doc_id, h, data in zip(batch["id"].tolist(), batch["h"].tolist(), batch["data"]):
                first, starts, anchor, g = runs_of(data, length, gram)
                if not len(first):
                    continue
                ends = (first + starts + (length - 1)).tolist()
                t = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends)], np.uint64).view(np.int64)
                out.append((np.full(len(first), doc_id), np.full(len(first), h), first, starts, anchor, g, t))
                held += len(first)
                if held > 200_000:
                    yield table(out)
                    out, held = [], 0
            if out:
                yield table(out)

    long = rows.where(F.length("data") >= length).select("id", "h", "data")
    return long.mapInPandas(find, "id bigint, h bigint, first bigint, starts int, anchor int, g bigint, t bigint")


_HEAD = struct.Struct("<HHHqq")


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which `at` bytes are known."""
    n = min(len(a), len(b))
    while at < n and a[at:at + 16] == b[at:at + 16]:
        at += 16
    if at >= n:
        return n
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_code(lines: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Sorted lines (text, text before, gram, run) as one front-coded run."""
    out, last = [], b""
    for text, before, g, t in lines:
        h = shared(last, text)
        out += (_HEAD.pack(h, len(text) - h, len(before), g, t), text[h:], before)
        last = text
    return b"".join(out)


def read_run(coded: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(length shared with the line before, text, text before, gram, run) of each line."""
    at, text = 0, b""
    while at < len(coded):
        h, rest, before, g, t = _HEAD.unpack_from(coded, at)
        at += _HEAD.size
        text = text[:h] + coded[at:at + rest]
        yield h, text, coded[at + rest:at + rest + before], g, t
        at += rest + before


class LoserTree:
    """Merges front-coded runs. Each run's line carries what it shares with the last line put out.

    The line that shares more comes first; only of lines that share as much are bytes compared, from there on, and the
    loser keeps what it shares with the winner.
    """

    def __init__(self, runs: list[bytes]):
        self.runs = [read_run(r) for r in runs]
        self.lines = [next(r, None) for r in self.runs]
        self.shares = [0 if x else -1 for x in self.lines]
        k = len(runs)
        self.losers, self.top = [-1] * k, 0
        for i in range(k):
            self._climb(i)

    def _second(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs."""
        x, y = self.shares[a], self.shares[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = self.lines[a][1], self.lines[b][1]
        h = shared(s, t, x)
        first = h == len(s) or h < len(t) and s[h] < t[h]
        winner, loser = (a, b) if first else (b, a)
        self.shares[loser] = h
        return winner, loser

    def _climb(self, run: int) -> None:
        node = (run + len(self.runs)) // 2
        while node:
            if self.losers[node] < 0:  # while the tree is built, the first to come waits
                self.losers[node] = run
                return
            run, self.losers[node] = self._second(run, self.losers[node])
            node //= 2
        self.top = run

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, int, int]]:
        """Lines in order; the first number is what a line shares with the line before it."""
        while self.shares[self.top] >= 0:
            run = self.top
            line = self.lines[run]
            yield self.shares[run], *line[1:]
            self.lines[run] = next(self.runs[run], None)
            self.shares[run] = self.lines[run][0] if self.lines[run] else -1
            self._climb(run)


def _repeats_of_group(group: list[tuple[int, bytes, bytes, int, int]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(gram, run, offset, starts) that repeat, of the lines of one gram in order.

    From each line the walk goes to its neighbours by falling common length. A neighbour that shares more before the
    anchor than those nearer settles more starts; the walk ends where no line shares more.
    """
    back = sorted((line[2][::-1], i) for i, line in enumerate(group))
    most = [0] * len(group)
    for (a, i), (b, j) in zip(back, back[1:]):
        h = shared(a, b)
        most[i], most[j] = max(most[i], h), max(most[j], h)
    for i, (_, text, before, g, t) in enumerate(group):
        anchor, starts = len(before), len(text) + len(before) - length + 1
        mine, best, hits = before[::-1], -1, []
        up, down = i - 1, i + 1
        r_up = group[i][0] if i else -1
        r_down = group[down][0] if down < len(group) else -1
        while best < most[i] or best < 0:
            r = max(r_up, r_down)
            if r < length - most[i] or r < 0:
                break
            if r_up >= r_down:
                other, up = up, up - 1
                r_up = min(r_up, group[up + 1][0]) if up >= 0 else -1
            else:
                other, down = down, down + 1
                r_down = min(r_down, group[down][0]) if down < len(group) else -1
            left = shared(mine, group[other][2][::-1])
            if left > best:
                best = left
                low, high = max(0, anchor - left), min(starts - 1, anchor - length + r)
                if low <= high:
                    hits.append((low, high))
        end = -1
        for low, high in sorted(hits):
            low = max(low, end + 1)
            if low <= high:
                yield g, t, low, high - low + 1
                end = high


def _merged(lines: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, t, offset, n): starts that repeat, of lines (g, t, before, text), by the distributed merge sort."""
    n = lines.count()
    sample = sorted({bytes(r["p"]) for r in bounded_sample(lines.select(F.col("text").substr(1, gram).alias("p"), "g", "t"), SAMPLE, "g", "t").select("p").collect()})
    parts = max(1, n // LINES)
    borders = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        for batch in batches:
            rows = sorted(zip(batch["text"], batch["before"], batch["g"], batch["t"]))
            ranges: dict[int, list] = {}
            for row in rows:
                ranges.setdefault(bisect_right(borders, row[0][:gram]), []).append(row)
            yield pd.DataFrame([(k, front_code(v)) for k, v in ranges.items()], columns=["range", "coded"])

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple[int, bytes, bytes, int, int]] = []
        for line in LoserTree(list(batch["coded"])):
            if line[0] < gram and group:
                out += _repeats_of_group(group, length) if len(group) > 1 else ()
                group = []
            group.append(line)
        if len(group) > 1:
            out += _repeats_of_group(group, length)
        return pd.DataFrame(out, columns=["g", "t", "offset", "n"])

    coded = lines.select("g", "t", "before", "text").mapInPandas(sort, "range int, coded binary")
    return coded.groupBy("range").applyInPandas(merge, "g bigint, t bigint, offset bigint, n bigint")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, h, start, n): n starts from `start` on whose string of `length` bytes also starts anywhere else."""
    rows = _rows(docs)
    runs = cut_lineage(_all_runs(rows, length, gram), "repeat-runs")
    grams = cut_lineage(runs.groupBy("g").agg(F.count("*").alias("c"), F.min("t").alias("a"), F.max("t").alias("b")).where("c > 1")
                        .select("g", (F.col("a") != F.col("b")).alias("mixed")), "repeat-grams")
    met = cut_lineage(runs.join(grams, "g"), "repeat-met")
    whole = met.where("NOT mixed").select("id", "h", F.col("first").alias("start"), F.col("starts").cast("bigint").alias("n"))
    mixed = met.where("mixed").drop("mixed")
    kinds = cut_lineage(mixed.groupBy("g", "t").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "first", "starts", "anchor")).alias("r")), "repeat-kinds")
    sizes = kinds.groupBy("g").agg(F.count("*").alias("many"))
    large = cut_lineage(sizes.where(F.col("many") > group).select("g", F.lit(True).alias("large")), "repeat-large")
    asked = (kinds.join(large, "g", "left").groupBy("r.id", "r.h")
             .agg(F.collect_list(F.struct("g", "t", "r.first", "r.starts", "r.anchor", F.coalesce("large", F.lit(False)).alias("large"))).alias("asked")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["g", "t", "before", "text", "offset", "digest"]
        for batch in batches:
            out: list[tuple] = []
            for data, asked in zip(batch["data"], batch["asked"]):
                for r in asked:
                    first, last, anchor = r["first"], r["first"] + r["starts"] - 1, r["first"] + r["anchor"]
                    if r["large"]:
                        out += [(r["g"], r["t"], None, None, p - first, xxhash.xxh3_128_digest(data[p:p + length])) for p in range(first, last + 1)]
                    else:
                        out.append((r["g"], r["t"], data[first:anchor], data[anchor:last + length], None, None))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns).astype({"offset": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=columns).astype({"offset": "Int64"})

    texts = rows.drop("doc_id").join(asked, ["id", "h"])
    lines = cut_lineage(texts.select("data", "asked").mapInPandas(cut, "g bigint, t bigint, before binary, text binary, offset bigint, digest binary"), "repeat-lines")
    single = lines.where("digest IS NOT NULL").select("g", "t", "offset", "digest").distinct()
    twice = single.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")
    by_digest = single.join(twice, "digest").select("g", "t", "offset", F.lit(1).cast("bigint").alias("n"))
    by_order = _merged(lines.where("digest IS NULL").select("g", "t", "before", "text").dropDuplicates(["g", "t"]), length, gram)
    alike = kinds.where("c > 1").select("g", "t", F.lit(0).cast("bigint").alias("offset"), F.col("r.starts").cast("bigint").alias("n"))
    found = by_order.unionByName(by_digest).join(kinds.where("c = 1").select("g", "t"), ["g", "t"], "left_semi").unionByName(alike)
    edges = mixed.join(found, ["g", "t"]).select("id", "h", (F.col("first") + F.col("offset")).alias("start"), "n")
    return whole.unionByName(edges)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every row."""
    bits = 12
    marked = repeated_starts(docs, length, gram, group).groupBy("id", "h").agg(
        F.collect_list(F.shiftleft("start", bits) + F.least("n", F.lit((1 << bits) - 1))).alias("starts"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, data, starts in zip(batch["doc_id"], batch["data"], batch["starts"]):
                removed = spans = 0
                kept = data
                if starts is not None and len(starts):
                    starts = np.asarray(starts, np.int64)
                    first, many = starts >> bits, starts & ((1 << bits) - 1)
                    change = np.bincount(first, minlength=len(data) + 1) - np.bincount(first + many - 1 + length, minlength=len(data) + 1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(data), removed, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_kept else ()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    return _rows(docs).join(marked, ["id", "h"], "left").select("doc_id", "data", "starts").mapInPandas(cut, schema)
