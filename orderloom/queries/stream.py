"""Batch twins of the streams, and streams that run over the given events until they are used up."""

from pyspark.sql import functions as F

from ..operators import monitoring as mo
from ..session import state_store, work_path
from ..streaming import jobs, sessions
from . import query

EV = ("order_events",)
KNOWN = "event_type IN ('store_confirm_needed', 'store_confirmed', 'sku_corrected', 'order_complete', 'order_cancelled', 'user_modified')"


@query("s13_known_events", f"SELECT event_type, count(*) AS n, sum(cast(json_extract_string(props, '$.k') AS bigint))::BIGINT AS k_sum FROM order_events WHERE {KNOWN} GROUP BY ALL", EV)
def _(t):
    return jobs.known_events(t.order_events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum"))


SESSIONS = """WITH e AS (SELECT *, event_type = 'store_confirm_needed' AS st, event_type IN ('order_complete', 'order_cancelled') AS en FROM order_events),
 s AS (SELECT *, sum(CASE WHEN st OR en THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - CASE WHEN en THEN 1 ELSE 0 END AS seg FROM e),
 g AS (SELECT session_id, seg, bool_or(st) AS had_start, bool_or(event_type = 'store_confirmed') AS ok, count(CASE WHEN event_type = 'sku_corrected' THEN 1 END) AS c, bool_or(event_type = 'user_modified') AS m, max(CASE WHEN event_type = 'order_complete' THEN ts END) AS completed_at,
   max(CASE WHEN event_type = 'order_complete' THEN event_id END) AS event_id, max(CASE WHEN event_type = 'order_complete' THEN value END) AS value FROM s GROUP BY ALL)
 SELECT session_id, completed_at, event_id, had_start, had_start AND ok AS store_confirmed, CASE WHEN had_start THEN c ELSE 0 END AS n_corrections, had_start AND m AS user_modified, value FROM g WHERE completed_at IS NOT NULL"""


@query("t01_order_sessions", SESSIONS, EV)
def _(t):
    return sessions.sessions_batch(t.order_events)




PASSED = "(SELECT * FROM order_events WHERE ts <= (SELECT max(ts) FROM order_events) - INTERVAL 1 HOUR)"
WITHIN = "had_start AND completed_at - started_at <= INTERVAL 24 HOUR"
ORDERED = SESSIONS.replace("FROM order_events)", f"FROM {PASSED})").replace("SELECT session_id, seg, ", "SELECT session_id, seg, max(CASE WHEN st THEN ts END) AS started_at, ")


@query("t01_ordered_sessions_stream", ORDERED.split(" SELECT session_id, completed_at")[0] + f""" SELECT session_id, completed_at, event_id, coalesce({WITHIN}, FALSE) AS had_start, coalesce({WITHIN} AND ok, FALSE) AS store_confirmed,
  CASE WHEN {WITHIN} THEN c ELSE 0 END AS n_corrections, coalesce({WITHIN} AND m, FALSE) AS user_modified, value FROM g WHERE completed_at IS NOT NULL""", EV)
def _(t):
    return drain(t, sessions.ordered_sessions_stream, "append").where("kind = 'record'").select(
        "session_id", "completed_at", "event_id", "had_start", "store_confirmed", "n_corrections", "user_modified", "value")


@query("a18_session_corrections_stream", ORDERED.split(" SELECT session_id, completed_at")[0] + f""" SELECT s.session_id, g.event_id AS order_event_id, s.event_id, s.ts AS at, s.event_type, s.value FROM s JOIN g ON s.session_id = g.session_id AND s.seg = g.seg
  WHERE s.event_type IN ('sku_corrected', 'store_corrected') AND {WITHIN.replace("had_start", "g.had_start").replace("completed_at", "g.completed_at").replace("started_at", "g.started_at")}""", EV)
def _(t):
    return drain(t, sessions.ordered_sessions_stream, "append").where("kind = 'correction'").select(
        "session_id", "order_event_id", "event_id", "at", "event_type", "value")


def own_layer():
    """The given events' layer and score."""
    return F.concat(F.lit("layer_"), (F.get_json_object("props", "$.k").cast("bigint") % 5).cast("string")), F.col("value") / 20


LAYERS = ("""SELECT CASE WHEN starts_with(event_type, 'store') THEN 'store' ELSE 'sku' END AS entity_type, concat('layer_', cast(cast(json_extract_string(props, '$.k') AS bigint) % 5 AS varchar)) AS layer_name, count(*) AS total_attempts,
  count(CASE WHEN event_type = 'store_confirmed' THEN 1 END) AS success_count, count(CASE WHEN event_type <> 'store_confirmed' THEN 1 END) AS user_corrected_count, sum(cast(value / 20 AS decimal(18,6)))::DOUBLE AS score_sum FROM order_events WHERE event_type IN ('store_confirmed', 'sku_corrected') GROUP BY ALL""", EV)


@query("t02_layer_statistics", *LAYERS)
def _(t):
    return jobs.layer_statistics(t.order_events, *own_layer())


@query("t02_layer_statistics_stream", *LAYERS)
def _(t):
    return drain(t, lambda e: jobs.layer_statistics(e, *own_layer()), "complete")


OPEN = ORDERED.split(",\n g AS")[0] + f""", o AS (SELECT session_id, seg, max(ts) AS started_at FROM s WHERE st GROUP BY ALL)
 SELECT 'store' AS entity_type, '' AS layer_name, 0::BIGINT AS total_attempts, 0::BIGINT AS success_count, 0::BIGINT AS user_corrected_count, 0::DOUBLE AS score_sum WHERE FALSE UNION ALL
 SELECT CASE WHEN starts_with(event_type, 'store') THEN 'store' ELSE 'sku' END, concat('layer_', cast(cast(json_extract_string(props, '$.k') AS bigint) % 5 AS varchar)), count(*),
  count(CASE WHEN event_type = 'store_confirmed' THEN 1 END), count(CASE WHEN event_type <> 'store_confirmed' THEN 1 END), sum(cast(value / 20 AS decimal(18,6)))::DOUBLE
  FROM s JOIN o USING (session_id, seg) WHERE event_type IN ('store_confirmed', 'sku_corrected') AND ts - started_at <= INTERVAL 24 HOUR GROUP BY ALL"""


@query("t02_open_layer_statistics", OPEN.replace(PASSED, "order_events"), EV)
def _(t):
    return jobs.layer_statistics(sessions.open_outcomes_batch(t.order_events, "24 hours"), *own_layer())


@query("t02_open_layer_statistics_stream", OPEN, EV)
def _(t):
    def inside(events):
        layer, score = own_layer()
        return sessions.ordered_sessions_stream(events.withColumns({"layer_name": layer, "match_score": score})).where("kind = 'outcome'")

    return jobs.layer_statistics(drain(t, inside, "append"), F.col("layer_name"), F.col("match_score"))


def drain(t, build, mode):
    """Write the events as files below the shared folder and run the stream over them until they are used up."""
    spark = t.spark
    path, out, state = work_path(spark, "events"), work_path(spark, "out"), work_path(spark, "state")
    t.order_events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(path)

    def keep(batch, epoch):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/result")

    stream = build(jobs.event_source(spark, path))
    with state_store(spark):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/result")


@query("t03_rejections", "SELECT user_id AS session_id, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS reject_count, 'high' AS severity FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(CASE WHEN event_id % 3 = 0 THEN 1 END) >= 2")
def _(t):
    acts = t.events.where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 3 == 0, "reject").otherwise("modify").alias("action"))
    return jobs.rejection_stream(acts)


@query("t03_rejections_until_quiet_stream", """WITH g AS (SELECT session_id, ts, event_id, event_type, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS brk FROM order_events WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM g)
  SELECT session_id, max(ts) + INTERVAL 60 MINUTE AS quiet_at, count(CASE WHEN event_type = 'order_cancelled' THEN 1 END) AS reject_count, 'high' AS severity FROM s GROUP BY session_id, seg
  HAVING reject_count >= 2 AND quiet_at <= (SELECT max(ts) FROM order_events) - INTERVAL 60 MINUTE""", EV)
def _(t):
    acts = drain(t, lambda e: jobs.rejections_until_quiet(e.withColumn("action", F.when(F.col("event_type") == "order_cancelled", "reject"))), "append")
    return acts.withColumn("quiet_at", F.col("quiet_at").cast("timestamp_ntz"))


STALLED = """WITH g AS (SELECT session_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM order_events WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
  s AS (SELECT session_id, ts, sum(brk) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM g) SELECT session_id, max(ts) AS last_ts, max(ts) + INTERVAL 30 MINUTE AS stalled_at, count(*) AS n_events FROM s GROUP BY session_id, seg"""


@query("t04_stalled_sessions", STALLED, EV)
def _(t):
    return as_given(jobs.stalled_sessions(t.order_events.withColumn("ts", F.col("ts").cast("timestamp"))))


@query("t04_stalled_sessions_stream", STALLED, EV)
def _(t):
    return as_given(drain(t, jobs.stalled_sessions, "complete"))


def as_given(stalled):
    return stalled.select("session_id", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), F.col("stalled_at").cast("timestamp_ntz").alias("stalled_at"), "n_events")


@query("t05_active_sessions", "SELECT session_id, max(ts) AS last_ts, count(*) AS n_events FROM order_events GROUP BY session_id HAVING max(ts) >= TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 60 MINUTE", EV)
def _(t):
    return mo.active_sessions(t.order_events, "2024-01-30 22:00:00", 60)


DAILY = "SELECT cast(ts AS date) AS day, event_type, count(*) AS n, sum(floor(value * 100))::BIGINT AS value_cents FROM order_events GROUP BY ALL"


@query("t06_daily_metrics_stream", DAILY, EV)
def _(t):
    return drain(t, jobs.daily_metrics, "complete")


@query("t06_daily_metrics", DAILY, EV)
def _(t):
    return jobs.daily_metrics(t.order_events.withColumn("ts", F.col("ts").cast("timestamp")))


@query("x01_event_handlers", f"SELECT event_type, count(*) AS n FROM order_events WHERE event_type IN ('order_complete', 'order_cancelled') GROUP BY ALL", EV)
def _(t):
    path, failed = work_path(t.spark, "handlers"), []

    def keep(rows, epoch):
        rows.select("event_id", "event_type").write.mode("append").parquet(path)

    def broken(rows, epoch):
        raise ValueError("a failing handler")

    jobs.dispatch({"order_complete": [broken, keep], "order_cancelled": [keep]}, lambda event, error: failed.append(event))(t.order_events, 0)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("x02_ratio_from_sql", "SELECT p_partkey, round(2.0e0 * length(p_name) / (2 * length(p_name) + 1), 6) AS ratio FROM part")
def _(t):
    from ..functions.similarity import register

    register(t.spark)
    return t.spark.sql("SELECT p_partkey, round(seq_ratio(p_name, concat(p_name, '!')), 6) AS ratio FROM {p}", p=t.part)
