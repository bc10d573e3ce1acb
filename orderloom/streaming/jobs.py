"""Streams over order events: source, statistics, alerts, windows and event handlers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.analytics import layer_counts
from ..operators.monitoring import order_alerts, reject_alerts

EVENT_SCHEMA = "event_id bigint, ts timestamp, session_id bigint, event_type string, value double, props string"


def event_source(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = EVENT_SCHEMA, **options: str) -> DataFrame:
    """Order events of the known types from a folder."""
    return known_events(spark.readStream.format(fmt).schema(schema).options(**options).load(path))


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Order events of the known types from a topic with JSON values."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return known_events(raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*"))


def known_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*fv.EVENT_TYPES))


def outcomes(events: DataFrame, layer: Column, score: Column) -> DataFrame:
    """Layer outcomes of confirm and correct events: (entity_type, layer_name, match_score, confirmed).

    layer and score are the event's own; scores are summed as decimals of six places, so that sums do not depend on order.
    """
    kind = F.col("event_type")
    rows = events.where(kind.isin("store_confirmed", "store_corrected", "sku_confirmed", "sku_corrected"))
    return rows.select(
        F.when(kind.startswith("store"), "store").otherwise("sku").alias("entity_type"),
        F.coalesce(layer, F.lit("")).alias("layer_name"), F.coalesce(score, F.lit(0.0)).cast("decimal(18,6)").alias("match_score"), kind.endswith("confirmed").alias("confirmed"))


def layer_statistics(events: DataFrame, layer: Column, score: Column) -> DataFrame:
    """Running layer statistics; in update mode every trigger emits the layers that changed."""
    return layer_counts(outcomes(events, layer, score)).withColumn("score_sum", F.col("score_sum").cast("double"))


def alert_stream(metrics: DataFrame) -> DataFrame:
    """Order alerts, stateless."""
    return order_alerts(metrics)


def rejection_stream(actions: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Sessions with repeated rejections (ts, session_id, action), update mode."""
    return reject_alerts(actions.withWatermark("ts", watermark))


def rejections_until_quiet(actions: DataFrame, gap: str = "1 hour", watermark: str = "1 hour", limit: int = fv.MAX_REJECTS) -> DataFrame:
    """Repeated rejections within a stretch of activity (ts, session_id, action).

    A stretch ends after `gap` without an action; its row is emitted and its state goes when the watermark passes that end.
    """
    stretch = actions.withWatermark("ts", watermark).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return stretch.agg(F.count_if(F.col("action") == "reject").alias("reject_count")).where(F.col("reject_count") >= limit).select(
        "session_id", F.col("w.end").alias("quiet_at"), "reject_count", F.lit("high").alias("severity"))


def stalled_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches of activity closed by `gap` without an event: the session stalled at the end of the stretch."""
    w = F.session_window("ts", gap)
    return events.groupBy("session_id", w).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts")).select(
        "session_id", "last_ts", F.col("session_window.end").alias("stalled_at"), "n_events")


def daily_metrics(events: DataFrame, period: str = "1 day") -> DataFrame:
    """Tumbling counts per day and event type."""
    return events.groupBy(F.window("ts", period), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("value_cents")).select(
        F.to_date("window.start").alias("day"), "event_type", "n", "value_cents")


def dispatch(handlers: Mapping[str, list[Callable[[DataFrame, int], None]]],
             on_error: Callable[[str, Exception], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: every handler gets the rows of its event type; a failing handler does not stop the others."""

    def run(batch: DataFrame, epoch: int) -> None:
        for event, functions in handlers.items():
            rows = batch.where(F.col("event_type") == event)
            for fn in functions:
                try:
                    fn(rows, epoch)
                except Exception as exc:  # noqa: BLE001 - isolation is the point
                    on_error(event, exc)

    return run
