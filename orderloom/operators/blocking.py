"""Containment and similarity joins through equi-keys that lose no pair."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import length_bound, near_tiles
from ..functions.text import grams
from ..session import cut_lineage

ROWS_PER_SALT = 50_000
GRAMS = (12, 6, 3, 2, 1)
TEXTS_PER_CELL = 4_000
CHARACTERS_PER_CELL = 80_000
# Pairs a task compares.
PAIRS_PER_TASK = 16_000_000
# Up to this many pairs a text, texts of a key are joined as rows.
FEW_PAIRS = 32


def _grid(left: DataFrame, right: DataFrame, keys: list[str], left_id: Column, right_id: Column,
          left_size: Column, right_size: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (`_row`, `_col`) they meet in: every pair of equal keys meets in one cell.

    The sizes are aggregates over a key, in cells. A key's left rows fall into as many rows of the grid as their count needs, its right rows into as many columns; each
    is copied along the other side only. Usual keys have one cell, and nothing is copied for them.
    """
    def sizes(df: DataFrame, size: Column, out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(size).cast("int").alias(out))

    def salt(df: DataFrame, which: Column, n: str, out: str) -> DataFrame:
        return df.withColumn(out, F.pmod(F.xxhash64(which), F.col(n)).cast("int"))

    def copies(df: DataFrame, n: str, out: str) -> DataFrame:
        return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))

    grid = sizes(left, left_size, "_rows").join(sizes(right, right_size, "_cols"), keys)
    l = copies(salt(left.join(grid, keys), left_id, "_rows", "_row"), "_cols", "_col").drop("_rows", "_cols")
    return l, copies(salt(right.join(grid, keys), right_id, "_cols", "_col"), "_rows", "_row").drop("_rows", "_cols")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Column,
                rows_per_salt: int = ROWS_PER_SALT, right_id: Column | None = None) -> DataFrame:
    """Equi-join whose hot keys are dealt on a grid by the measured size of both sides."""
    keys = list(keys)
    size = F.count(F.lit(1)) / rows_per_salt
    l, r = _grid(left, right, keys, left_id, right_id if right_id is not None else F.struct(*right.columns), size, size)
    return l.join(r, [*keys, "_row", "_col"]).drop("_row", "_col")


def containment_join(needles: DataFrame, hays: DataFrame, keys: Sequence[str] = (), needle: str = "needle",
                     hay: str = "hay", stored: bool = False, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """All (needle, hay) with the needle inside the hay, within equal keys.

    A contained needle has all its grams in the hay, so meeting on one of them, the rarest among the hays, finds every
    pair. Needles take the longest grams their length allows (of GRAMS): long grams are rare, so the pairs met grow with
    the pairs found. A gram that no hay has ends the search for its needle. Empty needles match nothing. Both sides of
    a gram are dealt by their measured sizes.
    Both sides are read more than once, so they are stored first, unless they are `stored` tables already.
    """
    keys = list(keys)
    hays = hays.select(*keys, hay).distinct()
    needles = needles.select(*keys, needle).where(F.length(needle) > 0).distinct()
    if not stored:
        hays, needles = cut_lineage(hays, "hays"), cut_lineage(needles, "needles")

    # Grams travel as short hashes: a chance collision only adds a pair that `contains` then drops. With them the
    # rarest gram is the smallest (count, hash) pair.
    def hashed(grams_of: Column) -> Column:
        return F.explode(F.transform(grams_of, lambda g: F.pmod(F.xxhash64(g), F.lit(2 ** 39)))).alias("_gram")

    # Hays give the grams of those lengths only that some needle takes.
    taken = F.lit(GRAMS[-1])
    for size in sorted(GRAMS):
        taken = F.when(F.length(needle) >= size, F.lit(size)).otherwise(taken)
    asked_sizes = needles.agg(F.collect_set(taken).alias("_sizes"))
    of_size = [F.when(F.array_contains("_sizes", size), grams(hay, size)).otherwise(F.array().cast("array<string>")) for size in GRAMS]
    hay_grams = hays.crossJoin(asked_sizes).select(*keys, hay, hashed(F.flatten(F.array(*of_size))))
    sizes = hay_grams.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_df"))
    wanted = grams(needle, GRAMS[-1])
    for size in sorted(GRAMS):
        wanted = F.when(F.length(needle) >= size, grams(needle, size)).otherwise(wanted)
    needle_grams = needles.withColumn("_grams", wanted).select(*keys, needle, F.size("_grams").alias("_need"), hashed(F.col("_grams")))
    rarest = (
        needle_grams.join(sizes, [*keys, "_gram"])
        .groupBy(*keys, needle, "_need")
        .agg(F.count(F.lit(1)).alias("_have"), F.min(F.struct("_df", "_gram")).alias("_r"))
        .where("_have = _need")
        .select(*keys, needle, F.col("_r._gram").alias("_gram"),
                F.ceil(F.col("_r._df") / rows_per_salt).cast("int").alias("_salts"))
    )
    # A hot gram is a grid: its hays are dealt to rows and its needles to columns, each copied along the other side.
    rarest = cut_lineage(rarest, "rarest")
    asked = rarest.groupBy(*keys, "_gram").agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("_cols"), F.max("_salts").alias("_rows"))
    hot = asked.where("_cols > 1 OR _rows > 1")
    one = F.lit(1)

    def dealt(df: DataFrame, own: str, which: Column, other: str) -> DataFrame:
        out = df.join(hot, [*keys, "_gram"], "left").withColumn(own, F.pmod(F.xxhash64(which), F.coalesce(f"{own}s", one)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}s", one) - 1))).drop("_rows", "_cols")

    left = dealt(rarest.drop("_salts"), "_col", F.col(needle), "_row")
    right = dealt(hay_grams.join(asked.select(*keys, "_gram"), [*keys, "_gram"], "left_semi"), "_row", F.col(hay), "_col")
    return (
        left.join(right, [*keys, "_gram", "_row", "_col"])
        .where(F.col(hay).contains(F.col(needle)))
        .select(*keys, needle, hay)
        .distinct()
    )


def similar_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, floor: float,
                  rows_per_salt: int = TEXTS_PER_CELL) -> DataFrame:
    """Pairs within equal keys whose sequence ratio may reach `floor`; no pair that reaches it is lost.

    The ratio is at most 2*min(len a, len b)/(len a + len b), so texts meet in bands of length. Where few texts share a
    key and a band they are joined as they are; of more, each side is packed into blocks, one row each, every two blocks
    of a cell meet on a grid, and there arrays compare the characters and the longest common subsequence of all pairs,
    tile by tile (`near_tiles`), so only near pairs become rows and a task holds no more than a tile's.
    """
    keys = list(keys)
    right = cut_lineage(right.select(*keys, b).where(F.length(b) > 0).distinct(), "right")
    left = cut_lineage(left.select(*keys, a).where(F.length(a) > 0).distinct(), "left")
    width = max((2 - floor) / floor * 1.000001, 1.05)  # the longer of two texts in neighbouring bands at most

    def band(c: str) -> Column:
        return F.floor(F.log(F.length(c)) / math.log(width)).cast("int")

    def sizes(df: DataFrame, c: str, n: str, blocks: str) -> DataFrame:  # long texts come in smaller blocks
        rows = F.count(F.lit(1))
        size = F.greatest(rows / rows_per_salt, F.sum(F.length(c)) / CHARACTERS_PER_CELL)
        return df.groupBy(*cell).agg(rows.alias(n), F.ceil(size).cast("int").alias(blocks))

    cell = [*keys, "_band"]
    right = right.withColumn("_band", band(b))
    left = left.withColumn("_band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: band(a) + d)))
    both = sizes(left, a, "_x", "_rows").join(sizes(right, b, "_y", "_cols"), cell)
    both = cut_lineage(both.withColumn("_many", F.col("_x") * F.col("_y") > FEW_PAIRS * (F.col("_x") + F.col("_y"))), "cells")
    few = left.join(both.where("not _many").select(*cell), cell, "left_semi").join(right, cell)
    few = few.where(length_bound(F.col(a), F.col(b)) >= floor).select(*keys, a, b)
    compared = both.where("_many").agg(F.sum(F.col("_x").cast("double") * F.col("_y"))).first()[0]
    if not compared:
        return few
    tasks = math.ceil(compared / PAIRS_PER_TASK)

    def blocks(df: DataFrame, c: str, own: str, other: str) -> DataFrame:
        """The texts of a block as one row, a copy for every block of the other side."""
        many = both.where("_many").select(*cell, F.col(f"{own}s").alias("_own"), F.col(f"{other}s").alias("_other"))
        dealt = df.join(many, cell).withColumn(own, F.pmod(F.xxhash64(c), F.col("_own")).cast("int"))
        packed = dealt.groupBy(*cell, own, "_other").agg(F.collect_list(c).alias(f"_of_{own}"))
        return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_other") - 1))).drop("_other").repartition(tasks, *cell, "_row", "_col")

    met = blocks(left, a, "_row", "_col").join(blocks(right, b, "_col", "_row"), [*cell, "_row", "_col"]).select(*keys, "_of__row", "_of__col")

    def near(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                *of, x, y = (column[k] for column in batch.columns)
                x, y = x.values, y.values
                for i, j in near_tiles(x.to_pylist(), y.to_pylist(), floor):
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(v, len(i)) for v in of), x.take(pa.array(i)), y.take(pa.array(j))], names=[*keys, a, b])

    found = met.mapInArrow(near, T.StructType([*(left.schema[k] for k in keys), left.schema[a], right.schema[b]]))
    return few.unionByName(found)


def nearest_by_ratio(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str,
                     floors: Sequence[float] = (0.5, 0.25, 0.125, 0.0625), lowest: float | None = 1e-6) -> DataFrame:
    """(keys, a, b, score): for every left text the right texts of equal keys with its highest ratio, if that is above 0.

    Equal texts come first, then the bound falls step by step. At each step all pairs that reach it are found, so a text
    with a pair there is done, and only the others go on to the next; the last step, `lowest`, takes any shared character.
    Without it texts whose nearest one lies below the floors are left out.
    """
    from ..functions.similarity import with_ratio

    keys = list(keys)
    right = cut_lineage(right.select(*keys, b).distinct(), "nearest-right")
    rest = cut_lineage(left.select(*keys, a).distinct(), "nearest-left")
    same = rest.where(F.length(a) > 0).join(right.withColumn(a, F.col(b)), [*keys, a])
    found = cut_lineage(same.select(*keys, a, b, F.lit(1.0).alias("score")), "nearest-equal")
    rest = cut_lineage(rest.join(found.select(*keys, a), [*keys, a], "left_anti"), "nearest-rest")
    for floor in (*floors, *([] if lowest is None else [lowest])):
        if rest.isEmpty():
            break
        near = cut_lineage(similar_pairs(rest, right, keys, a, b, floor), "nearest-pairs")
        scored = cut_lineage(with_ratio(near, a, b, floor, "score").where(F.col("score") >= floor), "nearest-scored")
        top = scored.groupBy(*keys, a).agg(F.max("score").alias("_top"))
        best = cut_lineage(scored.join(top, [*keys, a]).where("score = _top").select(*keys, a, b, "score"), "nearest-best")
        found = found.unionByName(best)
        rest = cut_lineage(rest.join(best.select(*keys, a), [*keys, a], "left_anti"), "nearest-rest")
    return found
