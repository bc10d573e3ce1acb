"""Quality by importance resampling: hashed n-gram models of good text and of all text, sampled by Gumbel top-k.

Words and neighbouring word pairs fall into a fixed number of buckets. One model counts the buckets over documents that
are labelled good, the other over all documents; a document's weight is the ratio of the two models, the sum of its
buckets' log ratios. The k documents with the largest weight plus a
Gumbel variable, drawn from a hash of doc_id and seed, are a sample without replacement in proportion to the weights.

Edge cases: null and empty texts have weight 0; very long texts are counted whole; a document labelled more than once is
good if any label says so; without good labels all weights are 0; repeated rows have the same variable and are kept or left
together unless the k-th place falls among them, where ties are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, may_be_among, texts

BUCKETS = 1 << 15
SMOOTHING = 1.0
#: Words whose hashes a task remembers.
KNOWN = 150_000


class Grams:
    """Buckets of a text's words and word pairs; each word is hashed once per process."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w)
        code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pair = (code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        single = code * np.uint64(0x9E3779B97F4A7C15)
        return (np.concatenate((single, pair)) >> np.uint64(40)).astype(np.int64) % self.buckets


def shortened(numbers: np.ndarray) -> bytes:
    """Whole numbers, in order, as the bytes of their steps; 255 stands for a step that goes on."""
    step = np.diff(np.sort(numbers), prepend=0)
    out = np.full(int((step // 255).sum()) + len(step), 255, np.uint8)
    out[np.cumsum(step // 255 + 1) - 1] = step % 255
    return out.tobytes()


def restored(steps: bytes) -> np.ndarray:
    """The numbers that `shortened` took, in order."""
    step = np.frombuffer(steps, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step < 255]


def bucket_counts(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over good documents, and over all. Each task sends one row a bucket at most.

    No text is shuffled: documents that may be good, by a bitmap of fixed size, meet the good ids as their buckets, about
    a byte each.
    """

    def summed(batches: Iterator[Iterator[np.ndarray]]) -> pd.DataFrame:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for numbers in batch:
                total += np.bincount(numbers, minlength=buckets)
        at = np.flatnonzero(total)
        return pd.DataFrame({"bucket": at, "n": total[at]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(buckets)
        yield summed(map(grams, batch["text"]) for batch in batches)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(buckets)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "steps": [shortened(grams(text)) for text in batch["text"]]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield summed(map(restored, batch["steps"]) for batch in batches)

    ids = good.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    likely = rows.where(may_be_among(rows, ids, "doc_id")).mapInPandas(sent, "doc_id bigint, steps binary")
    out = np.zeros((2, buckets))
    for k, counts in enumerate((likely.join(ids, "doc_id", "left_semi").select("steps").mapInPandas(met, "bucket bigint, n bigint"),
                                rows.select("text").mapInPandas(whole, "bucket bigint, n bigint"))):
        for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
            out[k, r["bucket"]] = r["n"]
    return out[0], out[1]


def log_ratios(good: np.ndarray, everything: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    if not good.sum():
        return np.zeros(len(good))
    p = [np.log(c + smoothing) - np.log(c.sum() + smoothing * len(c)) for c in (good, everything)]
    return p[0] - p[1]


def weights(docs: DataFrame, ratios: np.ndarray, temper: float | None = None) -> DataFrame:
    """doc_id, n_grams and log_weight of every row.

    temper: number of n-grams up to which evidence adds up, a longer text counting as one of so many; None, the default,
    takes the full ratio.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(text: pd.Series) -> pd.DataFrame:
        grams, out = Grams(len(sent.value)), []
        for t in text:
            g = grams(t)
            share = 1.0 if temper is None else min(1.0, temper / max(len(g), 1))
            out.append((len(g), float(sent.value[g].sum() * share)))
        return pd.DataFrame(out, columns=["n_grams", "log_weight"])

    scored = F.pandas_udf(run, "n_grams bigint, log_weight double")
    return texts(docs).withColumn("w", scored("text")).select("doc_id", "w.n_grams", "w.log_weight")


def gumbel_top(scored: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Adds gumbel_key and selected: the k largest keys and what ties with the k-th.

    The k-th key is found by narrowing: counts by bins of the current range, a thousand at most, until one bin's keys
    are one value; no task sees all keys, none is sorted.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = cut_lineage(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "gumbel")
    low, high, total = keyed.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("gumbel_key")).first()
    if k <= 0 or not total:
        return keyed.withColumn("selected", F.lit(False))
    if k >= total:
        return keyed.withColumn("selected", F.lit(True))
    need = k
    while low < high:
        width = (high - low) / 1000
        if width <= 0 or low + width == low:
            break
        inside = keyed.where(F.col("gumbel_key").between(low, high))
        bins = {int(r["bin"]): r for r in inside.groupBy(F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(999)).alias("bin"))
                .agg(F.count("*").alias("n"), F.min("gumbel_key").alias("a"), F.max("gumbel_key").alias("b")).collect()}
        for b in sorted(bins, reverse=True):
            if bins[b]["n"] >= need:
                low, high = bins[b]["a"], bins[b]["b"]
                break
            need -= bins[b]["n"]
    return keyed.withColumn("selected", F.col("gumbel_key") >= low)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, k: int | None = None, seed: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and selected of every document.

    k documents are selected: a share of all, by default the share of good ones among labelled documents.
    """
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = judged.where("quality = 1")
    scored = cut_lineage(weights(docs, log_ratios(*bucket_counts(docs, good, buckets))), "quality")
    if k is None:
        if share is None:
            share = judged.agg(F.avg("quality")).first()[0] or 0.0
        k = round(share * scored.count())
    return gumbel_top(scored, k, seed)
