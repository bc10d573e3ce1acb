"""Spelling variants: words of a corpus grouped under the form that a far more frequent word one edit away gives them.

Every word makes its deletions and its replacements by later letters; insertions and replacements by earlier letters are
the same pairs seen from the other word. The edits are hashed without being spelled out and probed against blocked Bloom
filters of the vocabulary, one shard for each word length, so that nearly all of them end in the task that made them.
Only positives are spelled and shuffled, to an equi-join with the vocabulary that removes false ones. Filters are
broadcast in slices of a fixed size, one after the other, however large the vocabulary is.

Edge cases: null and empty texts have no words; a null doc_id stands as an empty string in the hash; very long texts are
read whole and very long runs are words like any other (lengths from 63 on share a shard); ties of a form go to the
smallest word in code-point order; repeated rows count each time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut_lineage, texts

#: The letters of a run, the shortest word and its fewest occurrences, how much more frequent a form is.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
EVERY = 199

#: Bits of filter for a word, bytes of filter that are broadcast at a time, words that one task probes.
BITS_A_WORD = 32
SLICE_BYTES = 1 << 25
PROBED = 20_000
SHARDS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CELLS = 1 << 18


def corpus_words(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased runs of letters, one in `every` with a letter left out, that are long and frequent enough."""
    pattern = F.lit(f"[A-Z{LETTERS}]{{{least_length},}}")
    runs = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                              F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.char_length("run").alias("length"))
    at = (F.col("h") % F.col("length")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.col("length")))).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    z = h ^ np.uint64(length * 0xD1342543DE82EF95 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _places(h: np.ndarray, length: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Address of the 64-bit block and the four bits in it, for hashed words of one length."""
    z = _mixed(h, length)
    shard = min(length, SHARDS - 1)
    at = starts[shard] + ((z >> np.uint64(24)) % np.uint64(max(sizes[shard], 1))).astype(np.int64)
    bits = np.zeros(z.shape, np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((z >> np.uint64(6 * k)) & np.uint64(63))
    return at, bits


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """Length, places in the list, code points (words x letters) and powers of the hash base, in bounded parts."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, where in groups.items():
        powers = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(length, _BASE))))
        step = max(1, _CELLS // length)
        for a in range(0, len(where), step):
            part = where[a:a + step]
            points = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), "<u4").reshape(len(part), length)
            yield length, part, points.astype(np.uint64), powers


def _filter_cells(words: DataFrame, starts: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """at, bits: the blocks of the filter that have bits, all shards in one address space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, _, points, powers in _by_length(batch["word"].tolist()):
                at, bits = _places((points * powers[:length]).sum(1, dtype=np.uint64), length, starts, sizes)
                yield pd.DataFrame({"at": at, "bits": bits.view(np.int64)})

    return words.select("word").mapInPandas(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))


def _positives(words: list[str], letters: np.ndarray, cells: np.ndarray, low: int, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, str]]:
    """(place of the word, edited word) for edits that the slice of the filter from address `low` on holds."""

    def held(h: np.ndarray, length: int) -> np.ndarray:
        at, bits = _places(h, length, starts, sizes)
        at -= low
        here = (at >= 0) & (at < len(cells))
        return here & ((cells[np.where(here, at, 0)] & bits) == bits)

    for length, part, points, powers in _by_length(words):
        terms = points * powers[:length]
        before = np.cumsum(terms, 1, dtype=np.uint64)
        whole = before[:, -1:]
        if length > 1:
            fresh = np.ones(points.shape, bool)  # leaving out either of two like neighbours gives the same word
            fresh[:, 1:] = points[:, 1:] != points[:, :-1]
            i, p = np.nonzero(fresh)
            h = (before - terms + (whole - before) * _UNBASE)[i, p]
            ok = held(h, length - 1)
            for a, b in zip(i[ok].tolist(), p[ok].tolist()):
                w = words[part[a]]
                yield part[a], w[:b] + w[b + 1:]
        for letter in letters:
            i, p = np.nonzero(points < letter)
            h = whole[i, 0] + (letter - points[i, p]) * powers[p]
            ok = held(h, length)
            c = chr(int(letter))
            for a, b in zip(i[ok].tolist(), p[ok].tolist()):
                w = words[part[a]]
                yield part[a], w[:b] + c + w[b + 1:]


def near_words(words: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """word, n, other, n_other: each pair of words (word, n) one edit apart, once. `words` should be a stored table."""
    shard = F.least(F.char_length("word"), F.lit(SHARDS - 1)).alias("shard")
    counts = {r["shard"]: r["count"] for r in words.groupBy(shard).count().collect()}
    sizes = np.array([-(-counts.get(s, 0) * BITS_A_WORD // 64) for s in range(SHARDS)], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    letters = np.array(sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c <> ''").collect()), np.uint64)
    dealt = words.repartition(max(1, sum(counts.values()) // PROBED), "word")
    whole = cut_lineage(_filter_cells(words, starts, sizes), "spelling-filter")
    step = slice_bytes // 8
    found = []
    for low in range(0, max(int(sizes.sum()), 1), step):
        part = whole.where(F.col("at").between(low, low + step - 1)).toPandas()
        cells = np.zeros(min(step, max(int(sizes.sum()) - low, 1)), np.uint64)
        cells[part["at"].to_numpy(np.int64) - low] = part["bits"].to_numpy(np.int64).view(np.uint64)
        sent = words.sparkSession.sparkContext.broadcast(cells)

        def run(batches: Iterator[pd.DataFrame], low: int = low, sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                mine, n = batch["word"].tolist(), batch["n"].to_numpy()
                hits = list(_positives(mine, letters, sent.value, low, starts, sizes))
                at = [h[0] for h in hits]
                yield pd.DataFrame({"word": [mine[i] for i in at], "n": n[at], "other": [h[1] for h in hits]})

        found.append(cut_lineage(dealt.mapInPandas(run, "word string, n bigint, other string"), "spelling-positives"))
        sent.destroy()
    known = words.select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    return reduce(DataFrame.unionByName, found).join(known, "other").select("word", "n", "other", "n_other")


def _last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where following (word, form) ends. Each round doubles the way that has been followed."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame, times: int = TIMES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n): the near word of largest n if that is `times` the word's own."""
    words = cut_lineage(words.select("word", "n"), "spelling-words")
    pairs = near_words(words, slice_bytes)

    def side(word: str, n: str, other: str) -> Column:
        return F.struct(F.col(word).alias("word"), (-F.col(n)).alias("less"), F.col(other).alias("other"))

    both = pairs.select(F.explode(F.array(side("word", "n_other", "other"), side("other", "n", "word"))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    formed = cut_lineage(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                                F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"))
        .select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")), "spelling-near")
    roots = _last_forms(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """group_variants over the words of whole texts."""
    return group_variants(corpus_words(docs, every))
