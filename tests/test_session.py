"""Stored steps."""

import time

from pyspark.sql import functions as F

from orderloom import session


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    """The disk holds the shuffles of one step, however many steps a query stores before the driver collects its garbage."""
    before = shuffle_files(spark)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 100)
    stored = session.cut_lineage(rows.join(rows.groupBy("k").agg(F.sum("id").alias("s")), "k").repartition(3, "id"), "test")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) is None
    assert stored.count() == 20_000 and stored.agg(F.sum("s")).first()[0] == sum(range(20_000)) * 200
