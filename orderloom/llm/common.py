"""Helpers that several operators here share: text columns, stored steps, components, small numeric functions."""

from __future__ import annotations

import ctypes
import gc
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session

#: Stored tables after which the driver lets go of what finished work left: its heap grows with the number of jobs, not with the data.
LET_GO = 4
_stored = count(1)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes empty) and the columns named, nothing else of the table."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def packed(docs: DataFrame, *columns: str) -> Column:
    """The columns named, or all, as one struct, so that no name of theirs meets a column made here."""
    return F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row")


def release_memory() -> None:
    """Give memory that the driver's Python has freed back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """Let the driver forget what finished work left: Spark drops broadcasts and shuffles once their handles are collected."""
    release_memory()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """session.cut_lineage; now and then the driver lets go, as jobs of many rounds fill its heap long before their stage ends."""
    out = session.cut_lineage(df, name)
    if next(_stored) % LET_GO == 0:
        release_driver(df.sparkSession)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, UPPER, LOWER)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; absolute error below 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most `rows` rows, those of least hash of their keys: a repeatable sample. Tasks only send what the hash lets through."""
    total = df.count()
    mixed = F.xxhash64(*keys, F.lit("sample"))
    if total > rows:
        df = df.where(F.pmod(mixed, F.lit(total)) < 2 * rows)
    return df.orderBy(F.pmod(mixed, F.lit(max(total, 1))), *keys).limit(rows)


def sift(df: DataFrame, wanted: DataFrame, key: str, buckets: int = 1 << 16) -> DataFrame:
    """Rows of df whose key may be among wanted's: all that are, and few others while wanted's keys are fewer than buckets.

    Hash buckets of the keys are broadcast, `buckets` numbers at most, so that a join after it need not shuffle all of df.
    """
    bucket = lambda: F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket")
    return df.join(F.broadcast(wanted.select(bucket()).distinct()), bucket() == F.col("__bucket"), "left_semi")


def bitmap(values: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """Bits of the hash buckets that a long column's values fall into: a mebibyte by default, however many values there are."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    words = (values.select(at.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at % 64 AS int)) AS bit")
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).collect())
    out = np.zeros(bits // 64, np.int64)
    for r in words:
        out[r["word"]] = r["bit"]
    return out


def may_be_among(df: DataFrame, values: DataFrame, column: str, bits: int = 1 << 23) -> Column:
    """Condition on a long column of df: true where it is among the values', seldom elsewhere while those are fewer than the bits."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap(values, column, bits))

    def run(at: pd.Series) -> pd.Series:
        place = at.to_numpy()
        return pd.Series((sent.value[place >> 6] >> (place & 63)) & 1 == 1)

    return F.pandas_udf(run, "boolean")(F.pmod(F.xxhash64(column), F.lit(bits)))




def leave_out(df: DataFrame, values: DataFrame, key: str, buckets: int = 1 << 18) -> DataFrame:
    """Rows of df whose key is not among the values'. Only rows in a hash bucket with one of the values are shuffled; buckets bounds the broadcast."""
    bucket = lambda: F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket")
    taken = F.broadcast(values.select(bucket()).distinct())
    sure = df.join(taken, bucket() == F.col("__bucket"), "left_anti")
    maybe = df.join(taken, bucket() == F.col("__bucket"), "left_semi")
    return sure.unionByName(maybe.join(values.select(key), key, "left_anti").select(*df.columns))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b), both long: (node, root), root being the smallest node that is reachable.

    Large-star and small-star rounds: each keeps the components and pulls nodes to smaller ones, so the number of
    rounds grows with the logarithm of the longest chain. Every round is a stored table; minima are combined before
    they are shuffled, so a hub with many neighbours is no hot task.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a > b").distinct(), f"{name}-edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a > b").distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                                F.col("m").alias("b")).where("a > b").distinct())
        after = cut_lineage(small, f"{name}-round")
        # A fixed point is a forest of stars: every node has one parent and no parent has a parent. Edges are distinct, so
        # their number and two sums of their hashes tell a changed set from the same one.
        h = F.xxhash64("a", "b")
        last, mark = mark, after.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
        now = after
        if mark == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
