"""Operations metrics, alerts, decisions and trace analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import parsing as ps
from ..functions.text import round_half_up
from .ranking import top_k


# --- order metrics ---------------------------------------------------------------------------

def order_match(df: DataFrame) -> DataFrame:
    """Adds match_rate (percent, 1 digit, 0 without SKUs) and its status."""
    rate = F.when(F.col("sku_count") > 0, F.col("matched_sku_count") * 100.0 / F.col("sku_count")).otherwise(0.0)
    return df.withColumn("unmatched_sku_count", F.col("sku_count") - F.col("matched_sku_count")).withColumn(
        "match_rate", round_half_up(rate, 1)).withColumn(
        "match_status", F.when(rate >= 80, "success").when(rate >= 70, "warning").otherwise("critical"))


def daily_summary(metrics: DataFrame, keys: Sequence[str] = ("agent_id", "order_date")) -> DataFrame:
    """All agents and days in one aggregation."""
    n = F.count(F.lit(1))
    return metrics.groupBy(*keys).agg(
        n.alias("total_orders"), F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"), F.count_if(F.col("status") == "user_rejected").alias("rejected_count"),
        round_half_up(F.count_if(F.col("status") == "success") * 100.0 / n, 1).alias("success_rate"),
        round_half_up(F.avg("processing_time_ms"), 0).alias("avg_processing_time_ms"),
        round_half_up(F.sum(F.col("match_rate") * 10).cast("bigint") / n / 10.0, 1).alias("avg_match_rate"),
        F.sum("matched_sku_count").alias("total_matched"), F.sum("unmatched_sku_count").alias("total_unmatched"))


def seven_days(metrics: DataFrame, end: str) -> DataFrame:
    day = F.lit(end).cast("date")
    return metrics.where(F.col("order_date").between(F.date_sub(day, 6), day))


def weekly_trend(metrics: DataFrame, end: str) -> DataFrame:
    return seven_days(metrics, end).groupBy("agent_id", "order_date").agg(
        F.count(F.lit(1)).alias("daily_orders"), F.count_if(F.col("status") == "success").alias("daily_success"))


def weekly_total(metrics: DataFrame, end: str) -> DataFrame:
    return daily_summary(seven_days(metrics, end), ["agent_id"]).select(
        "agent_id", "total_orders", "success_count", "success_rate", "avg_processing_time_ms", "avg_match_rate")


def tool_usage(traces: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """Tool calls per group, the k most used (a report limit)."""
    counts = traces.where("step_type = 'tool_call'").groupBy(*keys, "tool_name").agg(F.count(F.lit(1)).alias("call_count"))
    return top_k(counts, keys, [F.col("call_count").desc(), F.col("tool_name")], k)


def counts_by_type(df: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    return df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))


def unresolved_per_day(alerts: DataFrame) -> DataFrame:
    return alerts.where("not is_resolved").groupBy("agent_id", F.to_date("created_at").alias("order_date")).agg(F.count(F.lit(1)).alias("alert_count"))


def unresolved_alerts(alerts: DataFrame, metrics: DataFrame, severity: str | None = None) -> DataFrame:
    """Unresolved alerts with the facts of their order."""
    rows = alerts.where("not is_resolved")
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    facts = metrics.select("order_id", F.col("status").alias("order_status"), "customer_id")
    return rows.join(facts, "order_id", "left")


def unresolved_total(alerts: DataFrame, agents: DataFrame) -> DataFrame:
    """Unresolved alerts over the active agents."""
    active = agents.where("is_active").select("agent_id")
    return alerts.where("not is_resolved").join(active, "agent_id", "left_semi").agg(F.count(F.lit(1)).alias("total_unresolved"))


def resolve_alerts(alerts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Alerts with flag and time set where a resolution (alert_id, resolved_at) exists."""
    r = resolved.groupBy("alert_id").agg(F.min("resolved_at").alias("resolved_at"))
    return alerts.join(r, "alert_id", "left").withColumn("is_resolved", F.col("is_resolved") | F.col("resolved_at").isNotNull())


def daily_report(metrics: DataFrame, alerts: DataFrame, traces_counts: DataFrame, feedback_counts: DataFrame) -> DataFrame:
    """Per agent and day: summary, alerts, tool calls and feedback side by side."""
    keys = ["agent_id", "order_date"]
    out = daily_summary(metrics).join(unresolved_per_day(alerts), keys, "left").join(traces_counts, keys, "left").join(feedback_counts, keys, "left")
    return out.fillna(0, ["alert_count", "tool_calls", "feedback_total"])


# --- operation log ---------------------------------------------------------------------------------

LOG_SCHEMA = (
    "timestamp string, skill_name string, order_id string, matched boolean, confidence double, sku_code string, user_action string, "
    "error string, store_id string, owner_code string, item_count bigint, processing_time_ms bigint")


def read_operation_log(spark, path: str) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def parse_operation_log(lines: DataFrame, body: str = "line") -> DataFrame:
    """The same for lines that are already in a column."""
    parsed = lines.select(F.from_json(body, LOG_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e._bad is null and e.order_id is not null").select("e.*").drop("_bad")


def period_report(log: DataFrame, period: str, ts: str = "ts", extra_keys: Sequence[str] = ("skill_name",)) -> DataFrame:
    """Day, week or month report of every skill at once; period is 'day', 'week' or 'month'."""
    n = F.count(F.lit(1))

    def share(cond: Column) -> Column:
        return round_half_up(F.count_if(cond) / n, 6)

    action = F.coalesce("user_action", F.lit("auto"))
    return log.groupBy(*extra_keys, F.date_trunc(period, ts).cast("date").alias("period_start")).agg(
        n.alias("total_orders"), F.count_if("matched").alias("matched_orders"), share(F.col("matched")).alias("match_rate"),
        round_half_up(F.sum(F.round(F.col("confidence") * 100).cast("bigint")) / n / 100.0, 4).alias("avg_confidence"),
        share(F.coalesce("confidence", F.lit(0.0)) < 0.8).alias("low_confidence_rate"),
        round_half_up(F.avg("processing_time_ms"), 0).alias("avg_processing_time_ms"),
        *[F.count_if(action == a).alias(f"n_{a}") for a in ("auto", "confirm", "skip", "correct")],
        share(action == "auto").alias("auto_rate"), share(action.isin("confirm", "correct")).alias("intervention_rate"))


def top_errors(log: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    counts = log.where("not matched").groupBy(*keys, F.coalesce("error", F.lit("unknown")).alias("error")).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, keys, [F.col("n").desc(), F.col("error")], k)


def top_stores(log: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    counts = log.where("store_id <> ''").groupBy(*keys, "store_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, keys, [F.col("n").desc(), F.col("store_id")], k)


def log_statistics(log: DataFrame, start: str | None = None, end: str | None = None, store: str | None = None) -> DataFrame:
    """Totals of a date range and store."""
    rows = log
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if store is not None:
        rows = rows.where(F.col("store_id") == store)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"), F.count_if(F.coalesce("confidence", F.lit(1.0)) < 0.8).alias("low_confidence"),
        F.coalesce(round_half_up(F.avg("confidence"), 4), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(round_half_up(F.avg("processing_time_ms"), 2), F.lit(0.0)).alias("avg_processing_time"))


# --- alerts and decisions ------------------------------------------------------------------------------

def order_alerts(metrics: DataFrame, rate_bands=tuple(fv.MATCH_RATE_BANDS), time_bands=tuple(fv.TIMEOUT_BANDS)) -> DataFrame:
    """One row per alert of an order. Rates are compared as fractions. Stateless, so it runs on streams too."""
    rate = F.when(F.col("sku_count") > 0, F.col("matched_sku_count") / F.col("sku_count")).otherwise(1.0)
    low, late = None, None
    for severity, limit in rate_bands:
        low = F.when(rate < limit, severity) if low is None else low.when(rate < limit, severity)
    for severity, limit in time_bands:
        hit = F.col("processing_time_ms") > limit
        late = F.when(hit, severity) if late is None else late.when(hit, severity)

    def alert(kind: str, severity: Column) -> Column:
        return F.when(severity.isNotNull(), F.struct(F.lit(kind).alias("alert_type"), severity.alias("severity")))

    unmatched = F.when((F.col("sku_count") > F.col("matched_sku_count")) & (rate < 0.8), F.lit("medium"))
    found = F.array_compact(F.array(alert("low_match_rate", low), alert("timeout", late), alert("unmatched_skus", unmatched)))
    return metrics.select("agent_id", "order_id", "order_date", F.explode(found).alias("_a")).select(
        "agent_id", "order_id", "order_date", "_a.alert_type", "_a.severity")


def reject_alerts(actions: DataFrame, key: str = "session_id", limit: int = fv.MAX_REJECTS) -> DataFrame:
    """Sessions with at least `limit` rejections in total."""
    return actions.groupBy(key).agg(F.count_if(F.col("action") == "reject").alias("reject_count")).where(
        F.col("reject_count") >= limit).withColumn("severity", F.lit("high"))


def rate_change(reports: DataFrame, keys: Sequence[str] = ("skill_name",), period: str = "period_start", rate: str = "match_rate",
                limit: float = fv.DECISION_LIMITS["trend"]) -> DataFrame:
    """Change against the period before: up, down or steady. Runs on reports, one row per period."""
    w = Window.partitionBy(*keys).orderBy(period)
    change = F.col(rate) - F.lag(rate).over(w)
    return reports.withColumn("change", round_half_up(change, 6)).withColumn(
        "trend", F.when(F.col("change").isNull(), "none").when(F.col("change") > limit, "up").when(F.col("change") < -limit, "down").otherwise("steady"))


def decide(reports: DataFrame, limits: Mapping[str, float] = fv.DECISION_LIMITS) -> DataFrame:
    """Multi-metric decision over reports with a change column: severity escalates check by check."""
    rate, low, hand, n = (F.col(c) for c in ("match_rate", "low_confidence_rate", "intervention_rate", "total_orders"))
    checks = {
        "match_rate": F.when(rate < limits["match_rate_critical"], "critical").when(rate < limits["match_rate_warning"], "warning"),
        "low_confidence": F.when(low > limits["low_conf_critical"], "critical").when(low > limits["low_conf_warning"], "warning"),
        "intervention": F.when(hand > limits["intervention_critical"], "critical").when(hand > limits["intervention_warning"], "warning"),
        "trend": F.when(F.col("change") < -limits["trend"], "warning"),
        "volume": F.when(n < limits["volume_dead"], "critical").when(n < limits["volume_warning"], "warning"),
    }
    m, c, h = checks["match_rate"], checks["low_confidence"], checks["intervention"]
    # A low-confidence rate raises the severity only while no check before it did; the intervention rate raises a medium one too.
    severity = (
        F.when((m == "critical") | (checks["volume"] == "critical"), "critical")
        .when((h == "critical") | ((c == "critical") & m.isNull()), "high")
        .when(m.isNotNull() | c.isNotNull() | h.isNotNull(), "medium").otherwise("low")
    )
    severity = F.coalesce(severity, F.lit("low"))
    quiet = n < limits["volume_warning"]
    decision = (
        F.when(severity == "critical", "upgrade_now").when(severity == "high", "plan_upgrade").when(severity == "medium", "plan_upgrade_mid_term")
        .when(quiet, "consider_tuning").otherwise("keep_watching")
    )
    priority = F.when((severity == "low") & quiet, "medium").otherwise(severity)
    reasons = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v)) for k, v in checks.items()]))
    advice = F.array_compact(F.array(*[
        F.coalesce(*[F.when(v == state, F.lit(text)) for (name, state), text in fv.DECISION_ADVICE.items() if name == k])
        for k, v in checks.items()]))
    return reports.withColumn("severity", severity).withColumn("decision", decision).withColumn("priority", priority).withColumn(
        "reasons", F.array_join(reasons, ";")).withColumn("advice", F.array_join(advice, ";"))


# --- traces ------------------------------------------------------------------------------------------------

def trace_steps(messages: DataFrame, session: str = "session_id", turn: str = "turn", body: str = "content",
                calls: str = "tool_calls") -> DataFrame:
    """Typed steps of messages: reasoning and tool calls of the assistant, recognised actions of the user.

    messages: session, turn, role, content, tool_calls (JSON array of name and arguments).
    """
    base = messages.select(session, turn, "role", F.col(body).alias("content"), F.col(calls).alias("calls"))
    thought = base.where("role = 'assistant'").select(session, turn, F.posexplode(ps.reasoning_blocks("content")).alias("pos", "content")).select(
        session, turn, "pos", F.lit("reasoning").alias("step_type"), "content")
    tools = base.where("role = 'assistant'").select(session, turn, F.posexplode(F.from_json(
        "calls", "array<struct<name:string,arguments:string>>")).alias("pos", "t")).select(
        session, turn, "pos", F.lit("tool_call").alias("step_type"), F.col("t.name").alias("tool_name"), F.col("t.arguments").alias("tool_args"))
    action = ps.user_action("content")
    acts = base.where("role = 'user'").select(session, turn, F.lit(0).alias("pos"), F.lit("user_action").alias("step_type"), "content", action.alias("action")).where(
        "action is not null")
    return thought.unionByName(tools, allowMissingColumns=True).unionByName(acts, allowMissingColumns=True)


def session_metrics(steps: DataFrame, key: str = "session_id") -> DataFrame:
    """Counts per step type, number of distinct tools and counts per action of each session."""
    s = F.col("step_type")
    return steps.groupBy(key).agg(
        F.count_if(s == "reasoning").alias("reasoning_count"), F.count_if(s == "tool_call").alias("tool_call_count"),
        F.count_if(s == "user_action").alias("user_action_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(s == "tool_call", F.col("tool_name")))), ",").alias("tool_names"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("confirm", "reject", "modify", "accept")])


def active_sessions(events: DataFrame, as_of: str, minutes: int = 60, key: str = "session_id") -> DataFrame:
    newest = events.groupBy(key).agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(mins=F.lit(minutes))
    return newest.where(F.col("last_ts") >= since)
