"""Best-of, top-k and tie selection that never sort or hold a whole hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import TIE_GAP
from ..session import cut_lineage


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key. Spark keeps k rows per key in each task before the shuffle (window group limit)."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col(out) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given full ordering."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def tied_rows(scored: DataFrame, keys: Sequence[str], score: str, gap: float = TIE_GAP) -> DataFrame:
    """All rows whose score lies within `gap` of the best of their key, with top_score: one row a candidate, none cut.

    The best score is a maximum that tasks combine before they send it; rows then meet it by an equi-join, which Spark
    can split where a key has many rows.
    """
    top = scored.groupBy(*keys).agg(F.max(score).alias("top_score"))
    top = top.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "top_score")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & scored[k].eqNullSafe(top[f"_k{i}"])
    near = scored.join(top, same).where(F.col("top_score") - F.col(score) < gap)
    return near.drop(*[f"_k{i}" for i in range(len(keys))])


def best_with_ties(scored: DataFrame, keys: Sequence[str], score: str, tie_break: str, payload: Sequence[str],
                   weight: str | None = None, gap: float = TIE_GAP) -> DataFrame:
    """Best score per key, how many rows lie within `gap` of it, and the first of these by `tie_break`.

    Columns out: keys, top_score, top (payload of the best score), n_tied, tied (payload of the first tied row).
    The tied rows themselves come from `tied_rows`.
    """
    row = F.struct(tie_break, *payload)
    return tied_rows(scored, keys, score, gap).groupBy(*keys, "top_score").agg(
        F.min(F.when(F.col(score) == F.col("top_score"), row)).alias("top"),
        F.sum(F.col(weight) if weight else F.lit(1)).cast("bigint").alias("n_tied"),
        F.min(row).alias("tied"))


def match_candidates(df: DataFrame, keys: Sequence[str], score: Column, threshold: float, k: int | None = None,
                     order: Sequence[Column] = ()) -> DataFrame:
    """Candidates at or above a threshold by any similarity, best first; k is the report size, None keeps all."""
    kept = df.withColumn("score", score).where(F.col("score") >= threshold)
    if k is None:
        return kept
    return top_k(kept, keys, [F.col("score").desc(), *order], k)


def pages(df: DataFrame, keys: Sequence[str], item: Column, per_page: int = 1000) -> DataFrame:
    """Rows of a key as arrays of structs, spread over as many pages as its count needs: nothing is cut.

    Columns out: keys, page, items (sorted).
    """
    rows = cut_lineage(df.select(*keys, item.alias("_item")), "page-items")  # read twice
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_page).alias("_pages"))
    rows = rows.join(counts, list(keys))
    paged = rows.withColumn("page", F.pmod(F.xxhash64("_item"), F.col("_pages")).cast("bigint"))
    return paged.groupBy(*keys, "page").agg(F.sort_array(F.collect_list("_item")).alias("items"))
