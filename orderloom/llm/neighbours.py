"""Nearest neighbours by cosine: stable projections to a few dimensions, kd-trees, and a chi-square stopping test.

Unit vectors are projected by Gaussian, that is 2-stable, vectors: the squared projected distance of a pair over its squared distance is
chi-squared with as many degrees of freedom as dimensions. So projected neighbours are taken in order of distance and verified on the original vectors until, were there a
nearer one than the k-th found, its projection would have come by now with the chance asked for.

The top of the kd-tree, fitted on a bounded sample, deals all rows to cells; a cell has a kd-tree of its own where it is
searched. A query first searches its own cell, which bounds its k-th distance, then every cell whose box the stopping
test doesn't rule out. Cells that hold many rows, copies of one vector say, are searched in parts, and queries in blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part; shorter vectors
count as followed by zeros; a row never finds its own vec_id; rows repeated under one vec_id count once; fewer
candidates than k are all returned; equal scores go by vec_id; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_sample, cut_lineage

DIMENSIONS = 12
#: Chance that a true neighbour has come before the search stops.
CERTAINTY = 0.97
#: Rows that the top tree is fitted on at most, rows of a cell about, cells at most, rows of a part, queries of a block.
SAMPLE, CELL, CELLS, PART, BLOCK = 20_000, 1_024, 2_048, 8_192, 20_000
LEAF = 32


def chi_square_cdf(x: float, dimensions: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dimensions // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, dimensions: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dimensions) < p else (low, middle)
    return high


class Tree:
    """kd-tree over points: median splits on the widest dimension, and the boxes of the leaves."""

    def __init__(self, points: np.ndarray, leaf: int, bounded: bool = True):
        dims = points.shape[1]
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, left and right child; leaves are ~number
        self.rows: list[np.ndarray] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        wide = (np.full(dims, -np.inf), np.full(dims, np.inf))

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
            mine = points[rows]
            spread = mine.max(0) - mine.min(0) if len(rows) else np.zeros(dims)
            d = int(np.argmax(spread))
            if len(rows) <= leaf or spread[d] == 0:
                self.rows.append(rows)
                boxes.append((mine.min(0), mine.max(0)) if bounded and len(rows) else (low, high))
                return ~(len(self.rows) - 1)
            value = float(np.median(mine[:, d]))
            left = mine[:, d] < value
            if not left.any():
                value = float(mine[:, d][mine[:, d] > value].min())
                left = mine[:, d] < value
            at = len(self.splits)
            self.splits.append((d, value, 0, 0))
            up, down = high.copy(), low.copy()
            up[d], down[d] = value, value
            a, b = grow(rows[left], low, up), grow(rows[~left], down, high)
            self.splits[at] = (d, value, a, b)
            return at

        self.root = grow(np.arange(len(points)), *wide)
        self.low, self.high = (np.array(x) for x in zip(*boxes))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                d, value, a, b = self.splits[node]
                left = points[rows, d] < value
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Least squared distance of a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(1)


def search(points: pd.DataFrame, queries: pd.DataFrame, k: int, limit: float) -> pd.DataFrame:
    """Rows (query_id, vec_id, score) of the k best of some points for each query; limit is the stopping quantile.

    Products are summed row by row, so that copies of a vector score the same.
    queries: query_id, asked (the vector), asked_at (its projection) and bound, the squared distance of the k-th neighbour known so far.
    """
    points = points.drop_duplicates("vec_id")
    ids = points["vec_id"].to_numpy()
    vectors, flat = np.stack(points["vector"].to_numpy()), np.stack(points["projected"].to_numpy())
    norms = np.sqrt((vectors * vectors).sum(1))
    tree = Tree(flat, LEAF)
    out: list[pd.DataFrame] = []
    for query_id, vector, projected, bound in zip(queries["query_id"], queries["asked"], queries["asked_at"], queries["bound"]):
        near = tree.distances(np.asarray(projected))
        order = np.argsort(near, kind="stable")
        length = np.sqrt((vector * vector).sum())
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        reach, at = bound, 0
        while at < len(order) and near[order[at]] <= limit * reach + 1e-9:
            rows = np.concatenate([tree.rows[i] for i in order[at:at + 8]])
            at += 8
            rows = rows[ids[rows] != query_id]
            found = np.concatenate((found, rows))
            scores = np.concatenate((scores, (vectors[rows] * vector).sum(1) / (norms[rows] * length)))
            best = np.lexsort((ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k:
                reach = min(reach, max(0.0, 2 - 2 * scores[-1]))
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found], "score": scores}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "i8", "vec_id": "i8"})


def _vectors(table: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.where("vec_id IS NOT NULL").select("vec_id", whole.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def nearest(table: DataFrame, is_query: Column, k: int = 5, dimensions: int = DIMENSIONS, certainty: float = CERTAINTY, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each row that is_query selects."""
    spark = table.sparkSession
    rows = _vectors(table)
    size, n = rows.agg(F.max(F.size("vector")), F.count("*")).first()
    size = size or 1
    gaussian = np.random.default_rng(seed).normal(size=(size, dimensions))

    def project(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        v = np.stack([np.pad(x, (0, size - len(x))) for x in column])
        v = v / np.abs(v).max(1, keepdims=True)
        return pd.Series(list((v / np.sqrt((v * v).sum(1, keepdims=True))) @ gaussian), index=column.index)

    padded = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vector")))
    rows = rows.select("vec_id", padded.alias("vector"), F.pandas_udf(project, "array<double>")("vector").alias("projected"))
    sample = bounded_sample(rows, SAMPLE, "vec_id").select("projected").collect()
    cells = min(CELLS, max(1, n // CELL))
    fitted = np.array([r[0] for r in sample]).reshape(-1, dimensions)
    top = Tree(fitted, max(1, -(-len(fitted) // cells)), bounded=False)
    sent = spark.sparkContext.broadcast(top)  # SAMPLE rows at most

    def cell_of(column: pd.Series) -> pd.Series:
        return pd.Series(sent.value.leaf_of(np.stack(column.to_numpy())) if len(column) else [], dtype="int64")

    dealt = cut_lineage(rows.withColumn("cell", F.pandas_udf(cell_of, "bigint")("projected")), "vectors")
    filled = {r["cell"]: r["c"] for r in dealt.groupBy("cell").agg(F.count("*").alias("c")).collect()}  # a row a cell
    parts = F.element_at(F.create_map(*[F.lit(x) for c, many in filled.items() for x in (c, -(-many // PART))]) if filled else F.create_map(F.lit(0).cast("bigint"), F.lit(1)), F.col("cell"))
    queries = dealt.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), F.col("projected").alias("asked_at"), F.col("cell").alias("home")).dropDuplicates(["query_id"])
    blocks = max(1, -(-queries.count() // BLOCK))
    points = dealt.select("cell", F.pmod(F.xxhash64("vec_id"), parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vector", "projected")
    limit = chi_square_quantile(certainty, dimensions)

    def searched(asked: DataFrame) -> DataFrame:
        asked = asked.select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.pmod(F.hash("query_id"), F.lit(blocks)).alias("block"),
                             "query_id", "asked", "asked_at", "bound")

        def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            return search(p, q if len(p) else q[:0], k, limit) if len(p) and len(q) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

        keys = ["cell", "part", "block"]
        return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id bigint, vec_id bigint, score double")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    own = cut_lineage(best(searched(queries.withColumn("cell", F.col("home")).withColumn("bound", F.lit(float("inf"))))), "neighbours-own")
    bounds = own.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).select(
        "query_id", F.when(F.col("c") == k, F.greatest(2 - 2 * F.col("s"), F.lit(0.0))).alias("bound"))
    bounded = queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def reached(projected: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(sent.value.distances(np.asarray(p)) <= limit * b + 1e-9) for p, b in zip(projected, bound)], dtype=object)

    others = (bounded.withColumn("to", F.explode(F.pandas_udf(reached, "array<bigint>")("asked_at", "bound"))).where("`to` <> home")
              .select("query_id", "asked", "asked_at", "bound", F.col("to").alias("cell")))
    others = others.where(F.element_at(F.create_map(*[F.lit(x) for c in filled for x in (c, True)]), F.col("cell"))) if filled else others
    return best(own.select("query_id", "vec_id", "score").unionByName(searched(others))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
