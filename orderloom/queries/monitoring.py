"""Operations metrics, alerts and decisions."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import parsing as ps
from ..operators import monitoring as mo
from . import query
from .scalars import ACTION_SQL

METRICS = """WITH om AS (SELECT *, sku_count - matched_sku_count AS unmatched_sku_count, floor(CASE WHEN sku_count > 0 THEN matched_sku_count * 100.0e0 / sku_count ELSE 0.0e0 END * 10 + 0.5 + 1e-9) / 10 AS match_rate,
  CASE WHEN sku_count > 0 THEN matched_sku_count * 100.0e0 / sku_count ELSE 0.0e0 END AS raw_rate FROM order_metrics)
"""
SUMMARY = """count(*) AS total_orders, count(CASE WHEN status = 'success' THEN 1 END) AS success_count, count(CASE WHEN status = 'failed' THEN 1 END) AS failed_count, count(CASE WHEN status = 'user_rejected' THEN 1 END) AS rejected_count,
  floor(count(CASE WHEN status = 'success' THEN 1 END) * 100.0e0 / count(*) * 10 + 0.5 + 1e-9) / 10 AS success_rate, floor(avg(processing_time_ms) + 0.5 + 1e-9)::DOUBLE AS avg_processing_time_ms,
  floor(sum(round(match_rate * 10)::BIGINT)::DOUBLE / count(*) / 10.0e0 * 10 + 0.5 + 1e-9) / 10 AS avg_match_rate, sum(matched_sku_count)::BIGINT AS total_matched, sum(unmatched_sku_count)::BIGINT AS total_unmatched"""
OM = ("order_metrics",)


def metrics(t):
    return mo.order_match(t.order_metrics)


@query("a01_daily_summary", METRICS + f"SELECT agent_id, order_date, {SUMMARY} FROM om GROUP BY agent_id, order_date", OM)
def _(t):
    return mo.daily_summary(metrics(t))


@query("a02_weekly_trend", METRICS + "SELECT agent_id, order_date, count(*) AS daily_orders, count(CASE WHEN status = 'success' THEN 1 END) AS daily_success FROM om WHERE order_date BETWEEN DATE '1998-06-24' AND DATE '1998-06-30' GROUP BY ALL", OM)
def _(t):
    return mo.weekly_trend(metrics(t), "1998-06-30")


@query("a02_weekly_total", METRICS + f"SELECT agent_id, total_orders, success_count, success_rate, avg_processing_time_ms, avg_match_rate FROM (SELECT agent_id, {SUMMARY} FROM om WHERE order_date BETWEEN DATE '1998-06-24' AND DATE '1998-06-30' GROUP BY agent_id) x", OM)
def _(t):
    return mo.weekly_total(metrics(t), "1998-06-30")


TOOLS = "SELECT agent_id, cast(created_at AS date) AS day, tool_name, count(*) AS call_count FROM traces WHERE step_type = 'tool_call' GROUP BY ALL"


@query("a03_tool_usage", f"SELECT agent_id, day, tool_name, call_count, row_number() OVER (PARTITION BY agent_id, day ORDER BY call_count DESC, tool_name) AS rank FROM ({TOOLS}) x QUALIFY rank <= 10", ("traces",))
def _(t):
    return mo.tool_usage(t.traces.withColumn("day", F.to_date("created_at")), ["agent_id", "day"])


@query("a04_feedback_by_type", f"SELECT session_id, {ACTION_SQL.format('content')} AS action, count(*) AS n FROM messages WHERE role = 'user' AND {ACTION_SQL.format('content')} IS NOT NULL GROUP BY ALL", ("messages",))
def _(t):
    acts = t.messages.where("role = 'user'").withColumn("action", ps.user_action("content")).where("action is not null")
    return mo.counts_by_type(acts, ["session_id"], "action")


@query("a05_unresolved_per_day", "SELECT agent_id, cast(created_at AS date) AS order_date, count(*) AS alert_count FROM alerts WHERE NOT is_resolved GROUP BY ALL", ("alerts",))
def _(t):
    return mo.unresolved_per_day(t.alerts)


@query("a05_unresolved_total", "SELECT count(*) AS total_unresolved FROM alerts WHERE NOT is_resolved AND agent_id IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')", ("alerts",))
def _(t):
    agents = t.orders.select(F.col("o_orderpriority").alias("agent_id")).distinct().withColumn("is_active", F.col("agent_id") != "5-LOW")
    return mo.unresolved_total(t.alerts, agents)


@query("a06_daily_report", METRICS + f""", d AS (SELECT agent_id, order_date, {SUMMARY} FROM om GROUP BY agent_id, order_date), al AS (SELECT agent_id, cast(created_at AS date) - 9000 AS order_date, count(*) AS alert_count FROM alerts WHERE NOT is_resolved GROUP BY ALL),
  tl AS (SELECT agent_id, order_date, sum(sku_count)::BIGINT AS tool_calls FROM om WHERE sku_count > 4 GROUP BY ALL), fb AS (SELECT agent_id, order_date, count(*) AS feedback_total FROM om WHERE status = 'failed' GROUP BY ALL)
  SELECT d.*, coalesce(alert_count, 0) AS alert_count, coalesce(tool_calls, 0) AS tool_calls, coalesce(feedback_total, 0) AS feedback_total FROM d LEFT JOIN al USING (agent_id, order_date) LEFT JOIN tl USING (agent_id, order_date) LEFT JOIN fb USING (agent_id, order_date)""", ("order_metrics", "alerts"))
def _(t):
    m = metrics(t)
    alerts = t.alerts.withColumn("created_at", F.date_sub("created_at", 9000))
    tools = m.where("sku_count > 4").groupBy("agent_id", "order_date").agg(F.sum("sku_count").alias("tool_calls"))
    feedback = m.where("status = 'failed'").groupBy("agent_id", "order_date").agg(F.count(F.lit(1)).alias("feedback_total"))
    return mo.daily_report(m, alerts, tools, feedback)


@query("a15_session_metrics", """SELECT session_id, count(CASE WHEN step_type = 'reasoning' THEN 1 END) AS reasoning_count, count(CASE WHEN step_type = 'tool_call' THEN 1 END) AS tool_call_count, count(CASE WHEN step_type = 'user_action' THEN 1 END) AS user_action_count,
  array_to_string(list_sort(list_distinct(list(tool_name) FILTER (WHERE step_type = 'tool_call'))), ',') AS tool_names, count(CASE WHEN action = 'confirm' THEN 1 END) AS n_confirm, count(CASE WHEN action = 'reject' THEN 1 END) AS n_reject,
  count(CASE WHEN action = 'modify' THEN 1 END) AS n_modify, count(CASE WHEN action = 'accept' THEN 1 END) AS n_accept FROM (SELECT session_id, step_type, coalesce(tool_name, '') AS tool_name, action FROM traces) x GROUP BY session_id""", ("traces",))
def _(t):
    return mo.session_metrics(t.traces)


@query("a16_order_match", METRICS + "SELECT order_id, sku_count, unmatched_sku_count, match_rate, CASE WHEN raw_rate >= 80 THEN 'success' WHEN raw_rate >= 70 THEN 'warning' ELSE 'critical' END AS match_status FROM om", OM)
def _(t):
    return metrics(t).select("order_id", "sku_count", "unmatched_sku_count", "match_rate", "match_status")


@query("s05_operation_log", "SELECT order_id, skill_name, matched, confidence, user_action, item_count, processing_time_ms FROM operation_log WHERE item_count <> 5", ("operation_log",))
def _(t):
    log = t.operation_log.withColumn("line", F.to_json(F.struct("skill_name", "order_id", "matched", "confidence", "user_action", "item_count", "processing_time_ms")))
    broken = F.when(F.col("item_count") == 5, F.substr("line", F.lit(3))).otherwise(F.col("line"))
    return mo.parse_operation_log(log.select(broken.alias("line"))).select("order_id", "skill_name", "matched", "confidence", "user_action", "item_count", "processing_time_ms")


def _period(period):
    share = "floor(count(CASE WHEN {0} THEN 1 END) / count(*) * 1000000 + 0.5 + 1e-9) / 1000000"
    actions = ", ".join(f"count(CASE WHEN user_action = '{a}' THEN 1 END) AS n_{a}" for a in ("auto", "confirm", "skip", "correct"))
    return f"""SELECT skill_name, cast(date_trunc('{period}', ts) AS date) AS period_start, count(*) AS total_orders, count(CASE WHEN matched THEN 1 END) AS matched_orders, {share.format('matched')} AS match_rate,
      floor(sum(round(confidence * 100)::BIGINT)::DOUBLE / count(*) / 100.0e0 * 10000 + 0.5 + 1e-9) / 10000 AS avg_confidence, {share.format('confidence < 0.8')} AS low_confidence_rate, floor(avg(processing_time_ms) + 0.5 + 1e-9)::DOUBLE AS avg_processing_time_ms,
      {actions}, {share.format("user_action = 'auto'")} AS auto_rate, {share.format("user_action IN ('confirm', 'correct')")} AS intervention_rate FROM operation_log GROUP BY 1, 2"""


LOG = ("operation_log",)
for _p in ("day", "week", "month"):
    @query(f"a12_report_{_p}", _period(_p), LOG)
    def _(t, period=_p):
        return mo.period_report(t.operation_log, period)


@query("a13_top_errors", "SELECT skill_name, error, n, row_number() OVER (PARTITION BY skill_name ORDER BY n DESC, error) AS rank FROM (SELECT skill_name, error, count(*) AS n FROM operation_log WHERE NOT matched GROUP BY ALL) x QUALIFY rank <= 5", LOG)
def _(t):
    return mo.top_errors(t.operation_log, ["skill_name"])


@query("a13_top_stores", "SELECT skill_name, store_id, n, row_number() OVER (PARTITION BY skill_name ORDER BY n DESC, store_id) AS rank FROM (SELECT skill_name, store_id, count(*) AS n FROM operation_log GROUP BY ALL) x QUALIFY rank <= 5", LOG)
def _(t):
    return mo.top_stores(t.operation_log, ["skill_name"])


@query("a14_log_statistics", """SELECT count(*) AS total, count(CASE WHEN matched THEN 1 END) AS matched, count(CASE WHEN confidence < 0.8 THEN 1 END) AS low_confidence, floor(avg(confidence) * 10000 + 0.5 + 1e-9) / 10000 AS avg_confidence,
  floor(avg(processing_time_ms) * 100 + 0.5 + 1e-9) / 100 AS avg_processing_time FROM operation_log WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1998-12-31' AND store_id = 'store7'""", LOG)
def _(t):
    return mo.log_statistics(t.operation_log, "1997-01-01", "1998-12-31", "store7")


REPORTS = "WITH rep AS (" + _period("month") + ")"


@query("w08_rate_change", REPORTS + """, ch AS (SELECT skill_name, period_start, match_rate, floor((match_rate - lag(match_rate) OVER (PARTITION BY skill_name ORDER BY period_start)) * 1000000 + 0.5 + 1e-9) / 1000000 AS change FROM rep)
  SELECT skill_name, period_start, match_rate, change, CASE WHEN change IS NULL THEN 'none' WHEN change > 0.05 THEN 'up' WHEN change < -0.05 THEN 'down' ELSE 'steady' END AS trend FROM ch""", LOG)
def _(t):
    return mo.rate_change(mo.period_report(t.operation_log, "month")).select("skill_name", "period_start", "match_rate", "change", "trend")


@query("q06_decisions", REPORTS + """, ch AS (SELECT *, floor((match_rate - lag(match_rate) OVER (PARTITION BY skill_name ORDER BY period_start)) * 1000000 + 0.5 + 1e-9) / 1000000 AS change FROM rep),
  c AS (SELECT *, CASE WHEN match_rate < 0.7 THEN 'critical' WHEN match_rate < 0.85 THEN 'warning' END AS m, CASE WHEN low_confidence_rate > 0.2 THEN 'critical' WHEN low_confidence_rate > 0.1 THEN 'warning' END AS l,
    CASE WHEN intervention_rate > 0.3 THEN 'critical' WHEN intervention_rate > 0.15 THEN 'warning' END AS h, CASE WHEN change < -0.05 THEN 'warning' END AS tr, CASE WHEN total_orders < 3 THEN 'critical' WHEN total_orders < 10 THEN 'warning' END AS v FROM ch),
  s AS (SELECT *, CASE WHEN m = 'critical' OR v = 'critical' THEN 'critical' WHEN h = 'critical' OR (l = 'critical' AND m IS NULL) THEN 'high' WHEN m IS NOT NULL OR l IS NOT NULL OR h IS NOT NULL THEN 'medium' ELSE 'low' END AS severity FROM c)
  SELECT skill_name, period_start, severity, CASE severity WHEN 'critical' THEN 'upgrade_now' WHEN 'high' THEN 'plan_upgrade' WHEN 'medium' THEN 'plan_upgrade_mid_term' ELSE CASE WHEN total_orders < 10 THEN 'consider_tuning' ELSE 'keep_watching' END END AS decision,
    CASE WHEN severity = 'low' AND total_orders < 10 THEN 'medium' ELSE severity END AS priority,
    array_to_string(list_filter(['match_rate:' || m, 'low_confidence:' || l, 'intervention:' || h, 'trend:' || tr, 'volume:' || v], lambda x: x IS NOT NULL), ';') AS reasons,
    array_to_string(list_filter([""" + ", ".join(f"CASE {c}{''.join(f" WHEN '{s}' THEN '{a}'" for (k, s), a in fv.DECISION_ADVICE.items() if k == n)} END" for c, n in (("m", "match_rate"), ("l", "low_confidence"), ("h", "intervention"), ("tr", "trend"), ("v", "volume"))) + """], lambda x: x IS NOT NULL), ';') AS advice FROM s""", LOG)
def _(t):
    return mo.decide(mo.rate_change(mo.period_report(t.operation_log, "month"))).select("skill_name", "period_start", "severity", "decision", "priority", "reasons", "advice")


ALERTS = METRICS + """, r AS (SELECT *, CASE WHEN sku_count > 0 THEN matched_sku_count::DOUBLE / sku_count ELSE 1.0e0 END AS rate FROM om)
SELECT agent_id, order_id, order_date, alert_type, severity FROM (
  SELECT agent_id, order_id, order_date, 'low_match_rate' AS alert_type, CASE WHEN rate < 0.5 THEN 'critical' WHEN rate < 0.7 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE rate < 0.8
  UNION ALL SELECT agent_id, order_id, order_date, 'timeout', CASE WHEN processing_time_ms > 300000 THEN 'high' ELSE 'medium' END FROM r WHERE processing_time_ms > 180000
  UNION ALL SELECT agent_id, order_id, order_date, 'unmatched_skus', 'medium' FROM r WHERE sku_count > matched_sku_count AND rate < 0.8) x"""


@query("q04_order_alerts", ALERTS, OM)
def _(t):
    return mo.order_alerts(t.order_metrics)


@query("t03_alert_stream_twin", ALERTS.replace("SELECT agent_id, order_id, order_date, alert_type, severity FROM (", "SELECT alert_type, severity, count(*) AS n FROM (") + " GROUP BY ALL", OM)
def _(t):
    from ..streaming.jobs import alert_stream

    return alert_stream(t.order_metrics).groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("q05_reject_alerts", "SELECT session_id, count(CASE WHEN action = 'reject' THEN 1 END) AS reject_count, 'high' AS severity FROM traces WHERE step_type = 'user_action' GROUP BY session_id HAVING count(CASE WHEN action = 'reject' THEN 1 END) >= 2", ("traces",))
def _(t):
    return mo.reject_alerts(t.traces.where("step_type = 'user_action'"))


@query("j23_unresolved_alerts", "SELECT alert_id, a.agent_id, a.order_id, severity, status AS order_status, customer_id FROM alerts a LEFT JOIN order_metrics m ON m.order_id = a.order_id WHERE NOT is_resolved AND severity = 'critical'", ("alerts", "order_metrics"))
def _(t):
    return mo.unresolved_alerts(t.alerts, t.order_metrics, "critical").select("alert_id", "agent_id", "order_id", "severity", "order_status", "customer_id").orderBy(F.col("alert_id").desc())


@query("m03_resolve_alerts", "SELECT alert_id, is_resolved OR alert_id % 7 = 0 AS is_resolved, CASE WHEN alert_id % 7 = 0 THEN created_at + INTERVAL 1 DAY END AS resolved_at FROM alerts", ("alerts",))
def _(t):
    done = t.alerts.where("alert_id % 7 = 0").select("alert_id", F.expr("created_at + interval 1 day").alias("resolved_at"))
    return mo.resolve_alerts(t.alerts, done).select("alert_id", "is_resolved", "resolved_at")


@query("n05_trace_steps", f"""SELECT session_id, turn, step_type, count(*) AS n, string_agg(coalesce(tool_name, action, ''), ',' ORDER BY pos) AS names FROM (
  SELECT session_id, turn, 'reasoning' AS step_type, NULL AS tool_name, NULL AS action, 0 AS pos FROM messages WHERE role = 'assistant' AND (session_id + turn) % 8 = 0
  UNION ALL SELECT session_id, turn, 'tool_call', unnest(json_extract_string(tool_calls, '$[*].name')), NULL, unnest(range(0, json_array_length(tool_calls)::INT)) FROM messages WHERE role = 'assistant' AND tool_calls IS NOT NULL
  UNION ALL SELECT session_id, turn, 'user_action', NULL, {ACTION_SQL.format('content')}, 0 FROM messages WHERE role = 'user' AND {ACTION_SQL.format('content')} IS NOT NULL) x GROUP BY session_id, turn, step_type""", ("messages",))
def _(t):
    steps = mo.trace_steps(t.messages)
    return steps.groupBy("session_id", "turn", "step_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", F.coalesce("tool_name", "action", F.lit("")).alias("name")))), lambda x: x["name"]), ",").alias("names"))
