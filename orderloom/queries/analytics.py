"""Feedback, corrections, versions and daily wrap."""

from pyspark.sql import functions as F

from ..operators import analytics as an
from . import query

FB, CO = ("feedback",), ("corrections",)


def r(expr, digits):
    s = 10 ** digits
    return f"floor(({expr}) * {s}.0e0 + 0.5e0 + 1e-9) / {s}.0e0"


@query("a07_daily_feedback", f"""SELECT order_date, count(*) AS total_orders, {r('avg(store_match_rate)', 6)} AS avg_store_match_rate, {r('avg(sku_match_rate)', 6)} AS avg_sku_match_rate, {r('avg(processing_time_ms)', 4)} AS avg_processing_time_ms,
  {r('count(CASE WHEN user_confirmed THEN 1 END) / count(*)', 6)} AS confirm_rate, {r('count(CASE WHEN user_modified THEN 1 END) / count(*)', 6)} AS modify_rate, {r('avg(json_array_length(corrections))', 6)} AS avg_corrections FROM feedback GROUP BY order_date""", FB)
def _(t):
    return an.daily_feedback(t.feedback)


@query("a07_recent_feedback", "SELECT order_date, count(*) AS total_orders FROM feedback WHERE order_date >= DATE '2001-07-25' GROUP BY order_date", FB)
def _(t):
    return an.daily_feedback(t.feedback, "2001-08-01", 7).select("order_date", "total_orders").orderBy(F.col("order_date").desc())


OUTCOMES = "SELECT correction_type AS entity_type, match_layer AS layer_name, floor(match_score * 1000) AS match_score, auto_matched AS confirmed FROM corrections"
COUNTS = "SELECT entity_type, layer_name, count(*) AS total_attempts, count(CASE WHEN confirmed THEN 1 END) AS success_count, count(CASE WHEN NOT confirmed THEN 1 END) AS user_corrected_count, sum(match_score) AS score_sum FROM o GROUP BY ALL"


def outcomes(t):
    return t.corrections.select(F.col("correction_type").alias("entity_type"), F.col("match_layer").alias("layer_name"), F.floor(F.col("match_score") * 1000).alias("match_score"), F.col("auto_matched").alias("confirmed"))


@query("a08_layer_report", f"WITH o AS ({OUTCOMES}), c AS ({COUNTS}) SELECT entity_type, layer_name, total_attempts, success_count, user_corrected_count, {r('success_count / total_attempts', 4)} AS success_rate, {r('score_sum / total_attempts', 4)} AS avg_match_score FROM c WHERE total_attempts >= 50", CO)
def _(t):
    return an.layer_report(an.layer_counts(outcomes(t)))


@query("s12_accumulate_layers", f"WITH o AS ({OUTCOMES}) SELECT entity_type, layer_name, total_attempts, success_count, user_corrected_count, score_sum::BIGINT AS score_sum FROM ({COUNTS}) x", CO)
def _(t):
    rows = t.corrections.withColumn("old", F.col("created_at") < F.lit("2024-01-15").cast("date"))

    def part(df):
        return an.layer_counts(df.select(F.col("correction_type").alias("entity_type"), F.col("match_layer").alias("layer_name"), F.floor(F.col("match_score") * 1000).alias("match_score"), F.col("auto_matched").alias("confirmed")))

    return an.merge_layer_counts(part(rows.where("old")), part(rows.where("not old")))


@query("a09_alias_candidates", "SELECT entity_name, corrected_value, count(*) AS cnt FROM corrections WHERE correction_type = 'sku' AND created_at >= DATE '2024-01-24' GROUP BY ALL HAVING count(*) >= 3 ORDER BY cnt DESC, entity_name, corrected_value LIMIT 20", CO)
def _(t):
    return an.alias_candidates(t.corrections, "2024-01-31")


@query("a10_daily_alias_summary", "SELECT entity_name, corrected_value, count(*) AS cnt FROM corrections WHERE correction_type = 'sku' AND created_at >= DATE '2024-01-29' AND created_at < DATE '2024-01-30' GROUP BY ALL HAVING count(*) >= 2", CO)
def _(t):
    return an.daily_alias_summary(t.corrections, "2024-01-30")


@query("a11_threshold_tuning", f"""SELECT match_layer, count(*) AS total, count(CASE WHEN auto_matched THEN 1 END) AS confirmed, count(CASE WHEN NOT auto_matched THEN 1 END) AS corrected,
  {r('count(CASE WHEN NOT auto_matched THEN 1 END) / count(*) * 100', 2)} AS correction_rate, {r('count(CASE WHEN NOT auto_matched THEN 1 END) / count(*) * 100', 2)} > 30 AS flagged FROM corrections WHERE created_at >= DATE '2024-01-01' GROUP BY match_layer HAVING count(*) >= 10""", CO)
def _(t):
    return an.threshold_tuning(t.corrections, "2024-01-31")


def pct(a, b):
    return r(f"coalesce({a} * 100.0e0 / nullif({b}, 0), 0)", 4)


VERSIONS = f"""WITH b AS (SELECT skill_version, count(*) AS total_orders, sum(sku_count)::BIGINT AS total_sku_items, sum(matched_sku_count)::BIGINT AS matched_sku_items, avg(sku_match_rate) AS sku, count(CASE WHEN sku_match_rate >= 1 THEN 1 END) AS perfect_match_orders,
   sum(store_count)::BIGINT AS total_store_items, sum(matched_store_count)::BIGINT AS matched_store_items, avg(store_match_rate) AS store, count(CASE WHEN user_confirmed THEN 1 END) AS user_confirmed_count, count(CASE WHEN user_modified THEN 1 END) AS user_modified_count, avg(processing_time_ms) AS ms FROM feedback GROUP BY skill_version),
 c AS (SELECT skill_version, count(*) AS total_corrections, count(DISTINCT c.feedback_id) AS orders_with_corrections FROM corrections c JOIN feedback f ON f.feedback_id = c.feedback_id GROUP BY skill_version),
 v AS (SELECT b.skill_version, total_orders, total_sku_items, matched_sku_items, {r('coalesce(matched_sku_items / nullif(total_sku_items, 0) * 100, 0)', 4)} AS overall_sku_match_rate, {r('sku * 100', 4)} AS avg_sku_match_rate, perfect_match_orders, total_store_items, matched_store_items,
   {r('coalesce(matched_store_items / nullif(total_store_items, 0) * 100, 0)', 4)} AS overall_store_match_rate, {r('store * 100', 4)} AS avg_store_match_rate, user_confirmed_count, {r('user_confirmed_count / total_orders * 100', 4)} AS user_confirmed_rate, user_modified_count,
   {r('user_modified_count / total_orders * 100', 4)} AS user_modified_rate, coalesce(total_corrections, 0) AS total_corrections, {r('coalesce(total_corrections, 0) / total_orders', 6)} AS avg_corrections_per_order, coalesce(orders_with_corrections, 0) AS orders_with_corrections, {r('ms', 2)} AS avg_processing_time_ms
   FROM b LEFT JOIN c ON c.skill_version = b.skill_version)
"""
VW = ("feedback", "corrections")


def versions(t):
    return an.version_metrics(t.feedback, t.corrections)


@query("a19_version_metrics", VERSIONS + "SELECT * FROM v", VW)
def _(t):
    return versions(t)


@query("a20_version_delta", VERSIONS + ", l AS (UNPIVOT (SELECT skill_version, " + ", ".join(f"{m}::DOUBLE AS {m}" for m in an.VERSION_METRICS) + " FROM v) ON " + ", ".join(an.VERSION_METRICS) + f""" INTO NAME metric VALUE value)
  SELECT metric, max(CASE WHEN skill_version = 'v5.0' THEN value END) AS old_value, max(CASE WHEN skill_version = 'v5.1' THEN value END) AS new_value, {r("max(CASE WHEN skill_version = 'v5.1' THEN value END) - max(CASE WHEN skill_version = 'v5.0' THEN value END)", 4)} AS diff,
  {r("(max(CASE WHEN skill_version = 'v5.1' THEN value END) - max(CASE WHEN skill_version = 'v5.0' THEN value END)) / nullif(max(CASE WHEN skill_version = 'v5.0' THEN value END), 0) * 100", 2)} AS pct_change FROM l GROUP BY metric""", VW)
def _(t):
    return an.version_delta(versions(t), "v5.0", "v5.1")


@query("a20_corrections_delta", """WITH n AS (SELECT skill_version, correction_type, count(*) AS n FROM corrections c JOIN feedback f ON f.feedback_id = c.feedback_id GROUP BY ALL)
  SELECT coalesce(a.correction_type, b.correction_type) AS correction_type, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n FROM (SELECT * FROM n WHERE skill_version = 'v5.0') a FULL JOIN (SELECT * FROM n WHERE skill_version = 'v5.1') b ON a.correction_type = b.correction_type""", VW)
def _(t):
    return an.corrections_delta(an.corrections_by_type(t.feedback, t.corrections), "v5.0", "v5.1")


@query("a24_version_counts", "SELECT skill_version, count(*) AS n FROM feedback GROUP BY ALL", FB)
def _(t):
    return t.feedback.groupBy("skill_version").agg(F.count(F.lit(1)).alias("n"))


WRAP = ["orders_total", "distinct_owners", "auto_confirmed", "user_modified", "avg_sku_match_rate", "avg_processing_ms", "total_skus", "total_alert_entries"]


def _wrap(where):
    return f"""WITH w AS (SELECT order_date, count(*)::DOUBLE AS orders_total, count(DISTINCT owner_code)::DOUBLE AS distinct_owners, count(CASE WHEN user_confirmed AND NOT user_modified THEN 1 END)::DOUBLE AS auto_confirmed, count(CASE WHEN user_modified THEN 1 END)::DOUBLE AS user_modified,
      {r('avg(CASE WHEN sku_count > 0 THEN sku_match_rate END)', 3)} AS avg_sku_match_rate, floor(avg(processing_time_ms) + 0.5 + 1e-9)::DOUBLE AS avg_processing_ms, sum(sku_count)::DOUBLE AS total_skus, sum(json_array_length(alerts))::DOUBLE AS total_alert_entries FROM feedback {where} GROUP BY order_date)
      SELECT order_date, metric, value FROM w UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(WRAP)}))"""


@query("a27_daily_wrap", _wrap(""), FB)
def _(t):
    return an.daily_wrap(t.feedback)


@query("u06_owner_wrap", _wrap("WHERE owner_code = 'Brand#7'"), FB)
def _(t):
    return an.daily_wrap(t.feedback, owner="Brand#7")


@query("a27_latest_corrections", "SELECT correction_id, correction_type, entity_name, corrected_value, match_layer FROM corrections WHERE cast(created_at AS date) = DATE '2024-01-20' ORDER BY created_at DESC, correction_id DESC LIMIT 20", CO)
def _(t):
    day = t.corrections.where(F.to_date("created_at") == F.lit("2024-01-20").cast("date"))
    return day.orderBy(F.col("created_at").desc(), F.col("correction_id").desc()).limit(20).select("correction_id", "correction_type", "entity_name", "corrected_value", "match_layer")


@query("a28_continuity", "SELECT event_type, cast(floor((epoch(TIMESTAMP '2024-01-31 12:00:00') - floor(epoch(max(ts)))) / 3600) AS bigint) AS gap_hours, CASE WHEN floor((epoch(TIMESTAMP '2024-01-31 12:00:00') - floor(epoch(max(ts)))) / 3600) > 72 THEN 'P0' WHEN floor((epoch(TIMESTAMP '2024-01-31 12:00:00') - floor(epoch(max(ts)))) / 3600) > 24 THEN 'WARN' ELSE 'OK' END AS status FROM events GROUP BY event_type")
def _(t):
    return an.continuity(t.events, "event_type", "ts", "2024-01-31 12:00:00")


@query("j24_selected_corrections", "SELECT correction_id, entity_name FROM corrections WHERE feedback_id IN (SELECT feedback_id FROM feedback WHERE user_modified)", VW)
def _(t):
    return t.corrections.join(t.feedback.where("user_modified").select("feedback_id"), "feedback_id", "left_semi").select("correction_id", "entity_name")


@query("n03_json_measures", "SELECT feedback_id, cast(json_array_length(corrections) AS bigint) AS n_corrections, cast(json_extract_string(corrections, '$[0].match_score') AS double) AS first_score FROM feedback", FB)
def _(t):
    return t.feedback.select("feedback_id", an.json_length(F.col("corrections")).cast("bigint").alias("n_corrections"), F.get_json_object("corrections", "$[0].match_score").cast("double").alias("first_score"))


@query("n04_correction_rows", """SELECT feedback_id, pos, CASE WHEN k = 1 THEN 'sku' WHEN pos = 0 THEN 'store' ELSE 'sku' END AS correction_type, CASE WHEN k = 1 THEN 'a' WHEN pos = 0 THEN 's' ELSE 'c' END AS entity_name, CASE WHEN k = 2 AND pos = 0 THEN 's' ELSE '' END AS original_value,
  CASE WHEN k = 1 THEN 'b' WHEN pos = 0 THEN 't' ELSE '' END AS corrected_value, CASE WHEN k = 1 THEN 'L1' ELSE '' END AS match_layer, CASE WHEN k = 1 THEN 0.5e0 WHEN pos = 0 THEN 0.0e0 ELSE 0.25e0 END AS match_score, NOT (k = 2 AND pos = 1) AS auto_matched
  FROM (SELECT feedback_id, feedback_id % 3 AS k, unnest(range(0, feedback_id % 3)) AS pos FROM feedback) x""", FB)
def _(t):
    return an.correction_rows(t.feedback)
