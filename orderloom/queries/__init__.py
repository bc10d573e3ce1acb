"""Registered queries: each is a Spark query over the given tables and, where SQL can say it, its twin for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and derived inputs of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        from ..sources.tables import VIEWS

        if name in VIEWS:
            return view(self.spark, self.folder, name)
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register fn(inputs) under a name, with the twin query text."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register


def load() -> None:
    from . import analytics, monitoring, normalise, scalars, sku, sources, store, stream, texts  # noqa: F401
