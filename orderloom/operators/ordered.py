"""Running operations over an ordered key, split into blocks so that one long key spreads over many tasks.

Each helper summarises every block (map-side combined), runs the window over the few block summaries only, and joins
the carried value back to the rows, which then need a window inside their own block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _blocked(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Rows with their block, and key and block as one struct, which equals itself where a key is null."""
    return df.withColumn("_block", block).withColumn("_key", F.struct(*keys, "_block"))


def _inside(order: Sequence[Column]):
    return Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _join_blocks(df: DataFrame, summary: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows with the values of their block, dealt by `_key`, as the windows inside a block need them: one shuffle serves both."""
    return df.join(summary.select(F.struct(*keys, "_block").alias("_key"), *values), "_key")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, out: str = "row_no") -> DataFrame:
    """1, 2, 3, … per key. `block` must rise with the order, e.g. the leading order column or a coarse form of it."""
    blocked = _blocked(df, keys, block)
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
    return (
        _join_blocks(blocked, offsets, keys, ["_offset"])
        .withColumn(out, (F.row_number().over(Window.partitionBy("_key").orderBy(*order)) + F.col("_offset")).cast("bigint"))
        .drop("_key", "_block", "_offset")
    )


def fill_forward(df: DataFrame, keys: Sequence[str], order_col: str, value: str, out: str,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Last non-null value at or above the row, by a whole-numbered order column."""
    blocked = _blocked(df, keys, F.floor(F.col(order_col) / block_rows))
    last = blocked.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order_col))).alias("_last"))
    carried = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(_before(keys)))
    return (
        _join_blocks(blocked, carried, keys, ["_carry"])
        .withColumn(out, F.coalesce(
            F.last(value, ignorenulls=True).over(_inside([F.col(order_col)])), F.col("_carry")))
        .drop("_key", "_block", "_carry")
    )


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, flag: Column, out: str,
                  before_row: bool = False) -> DataFrame:
    """Number of flagged rows up to the row (or strictly before it) within the key."""
    blocked = _blocked(df, keys, block).withColumn("_flag", F.when(flag, 1).otherwise(0))
    counts = blocked.groupBy(*keys, "_block").agg(F.sum("_flag").alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
    inside = F.sum("_flag").over(_inside(order)) + F.col("_offset")
    if before_row:
        inside = inside - F.col("_flag")
    return _join_blocks(blocked, offsets, keys, ["_offset"]).withColumn(out, inside.cast("bigint")).drop("_key", "_block", "_flag", "_offset")


def number_groups(df: DataFrame, keys: Sequence[str], group: str, order: Column, block: Column, out: str) -> DataFrame:
    """1, 2, 3, … per key for each value of `group`, by its first occurrence: all rows of a value share its number.

    Rows are first reduced to the first place of each value (combined before the shuffle); only these are numbered.
    """
    placed = df.withColumn("_at", order).withColumn("_blk", block)
    firsts = placed.groupBy(*keys, group).agg(F.min("_at").alias("_at"), F.min("_blk").alias("_blk"))
    numbered = number_rows(firsts, keys, [F.col("_at"), F.col(group)], F.col("_blk"), out)
    right = numbered.select(*[F.col(k).alias(f"_g_{k}") for k in [*keys, group]], out)
    same = F.lit(True)
    for k in [*keys, group]:
        same = same & df[k].eqNullSafe(right[f"_g_{k}"])
    return df.join(right, same).drop(*[f"_g_{k}" for k in [*keys, group]])
