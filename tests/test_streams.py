"""Streams against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from orderloom.streaming import jobs, sessions

KINDS = ["store_confirm_needed", "store_confirmed", "sku_corrected", "user_modified", "order_complete", "order_cancelled"]


def events(spark, tmp_path, n=300):
    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=3 * i), i % 7, rnd.choice(KINDS), float(i % 11), '{"k": %d}' % (i % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, jobs.EVENT_SCHEMA)
    for part in range(3):  # three files, read one after the other
        df.where((F.col("event_id") >= part * n // 3) & (F.col("event_id") < (part + 1) * n // 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df


def drain(spark, stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_session_records_equal_batch(spark, tmp_path):
    from orderloom.session import SETTINGS

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])
    batch = events(spark, tmp_path)
    source = jobs.event_source(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    got = drain(spark, sessions.sessions_stream(source), "append", tmp_path, "records").collect()
    want = sessions.sessions_batch(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_layer_statistics_equal_batch(spark, tmp_path):
    layer, score = F.concat(F.lit("layer_"), F.get_json_object("props", "$.k")), F.col("value") / 8
    batch = events(spark, tmp_path)
    source = jobs.event_source(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    got = drain(spark, jobs.layer_statistics(source, layer, score), "complete", tmp_path, "layers").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, jobs.layer_statistics(batch, layer, score).collect()))


def test_windows_run_on_a_stream(spark, tmp_path):
    batch = events(spark, tmp_path)
    source = jobs.event_source(spark, str(tmp_path / "in")).withWatermark("ts", "1 hour")
    days = drain(spark, jobs.daily_metrics(source), "complete", tmp_path, "days").collect()
    assert sorted(map(tuple, days)) == sorted(map(tuple, jobs.daily_metrics(batch).collect())) and days
    source = jobs.event_source(spark, str(tmp_path / "in")).withWatermark("ts", "1 hour")
    stalled = drain(spark, jobs.stalled_sessions(source, "10 minutes"), "complete", tmp_path, "stalled").collect()
    assert sorted(map(tuple, stalled)) == sorted(map(tuple, jobs.stalled_sessions(batch, "10 minutes").collect())) and stalled


def test_failing_handler_does_not_stop_others(spark, tmp_path):
    seen, errors = [], []

    def bad(rows, epoch):
        raise ValueError("no")

    jobs.dispatch({"order_complete": [bad, lambda rows, epoch: seen.append(rows.count())]}, lambda e, x: errors.append(e))(events(spark, tmp_path), 0)
    assert errors == ["order_complete"] and seen[0] > 0


def late_events(spark, tmp_path):
    """Files whose events are shuffled by up to an hour, an order open for over a day, and one event that ends all waiting."""
    rnd = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=3 * i), i % 7, rnd.choice(KINDS), float(i % 11), None) for i in range(400)]
    rows += [(1000, start, 50, "store_confirm_needed", 1.0, None), (1001, start + dt.timedelta(hours=1), 50, "sku_corrected", 2.0, None),
             (1002, start + dt.timedelta(hours=30), 50, "order_complete", 3.0, None)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.randint(0, 55)))
    last = (2000, start + dt.timedelta(days=9), 99, "store_confirm_needed", 0.0, None)
    for part in range(0, len(rows), 50):
        spark.createDataFrame(rows[part:part + 50], jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([last], jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, jobs.EVENT_SCHEMA)


def test_late_events_are_put_in_order(spark, tmp_path):
    from orderloom.session import SETTINGS

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])
    batch = late_events(spark, tmp_path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    source = jobs.event_source(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    got = drain(spark, sessions.ordered_sessions_stream(source), "append", tmp_path, "ordered")
    want = sessions.sessions_batch(batch, "24 hours")
    records = got.where("kind = 'record'").select(want.columns).collect()
    assert sorted(map(tuple, records)) == sorted(map(tuple, want.collect())) and len(records) > 20
    assert [r.had_start for r in records if r.session_id == 50] == [False]
    want = sessions.corrections_batch(batch, "24 hours")
    assert sorted(map(tuple, got.where("kind = 'correction'").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 5
    inside = [r.event_id for r in got.where("kind = 'outcome'").collect()]
    assert sorted(inside) == sorted(r.event_id for r in sessions.open_outcomes_batch(batch, "24 hours").collect())
    outcomes = batch.where(F.col("event_type").isin("store_confirmed", "sku_corrected")).count()
    assert 1001 in inside and 20 < len(inside) < outcomes  # those without a start do not count


def test_rejections_end(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    minutes = {1: [0, 10, 20], 2: [0, 200], 3: [5, 15, 300, 310]}
    rows = [(i, start + dt.timedelta(minutes=m), s, "order_complete", 0.0, None) for s, all_of in minutes.items() for i, m in enumerate(all_of)]
    for at, part in ((0, rows), (1, [(9, start + dt.timedelta(days=2), 4, "order_complete", 0.0, None)])):
        spark.createDataFrame(part, jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = jobs.event_source(spark, str(tmp_path / "in"), maxFilesPerTrigger="1").withColumn("action", F.lit("reject"))
    q = jobs.rejections_until_quiet(source).writeStream.outputMode("append").format("memory").queryName("ended").option(
        "checkpointLocation", str(tmp_path / "ended")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.session_id, r.reject_count) for r in spark.table("ended").collect()) == [(1, 3), (3, 2), (3, 2)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only the last action, which is still open


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config(
    "spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {work!r}).getOrCreate()
import __spark_entry__ as entry
key = "spark.sql.streaming.stateStore.providerClass"
before = spark.conf.get(key)
for name in ("t01_ordered_sessions_stream", "a18_session_corrections_stream", "t02_open_layer_statistics_stream"):
    print("rows", entry.queries()[name](spark, {folder!r}).count())
assert spark.conf.get(key) == before
"""


def test_ordered_streams_run_in_a_session_of_another_place(tmp_path):
    """Another folder, no PYTHONPATH, and a session that names no state store: the driver's helper process does not find the package."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = ELSEWHERE.format(repo=repo, work=str(tmp_path / "work"), folder="/root/testdata/sf0.001")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    counts = [int(line.split()[1]) for line in done.stdout.splitlines() if line.startswith("rows")]
    assert done.returncode == 0 and len(counts) == 3 and min(counts) > 0, done.stderr[-3000:]
