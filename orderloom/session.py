"""Session settings that the operators assume, and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; master and partitions only where the cluster sets none."""
    builder = SparkSession.builder.appName("orderloom")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting holds for what starts inside; the session gets its own back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def state_store(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries started inside keep their state in RocksDB, which transformWithState needs, whatever the session names."""
    return _set(spark, STATE_STORE, SETTINGS[STATE_STORE])


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names. Local sessions that name none get a folder of their own machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        global _own_folder
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="orderloom-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        return _own_folder
    return None


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    base = shared_folder(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/orderloom-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so later stages neither recompute the rows nor lose them with an executor.

    The rows read back also carry their true size, from which Spark picks the joins that follow. The shuffle files of the
    write go when it ends, not when the driver next happens to collect its garbage, so the disk holds those of one step.
    """
    path = work_path(df.sparkSession, name)
    with _set(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
