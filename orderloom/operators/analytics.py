"""Aggregates over feedback, corrections and text indexes. Dates to look back from are arguments, never today."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import round_half_up

CORRECTIONS = "array<struct<type:string,original:string,original_name:string,corrected:string,match_layer:string,match_score:double,auto_matched:boolean>>"


def json_length(c: Column) -> Column:
    return F.coalesce(F.json_array_length(c), F.lit(0))


def daily_feedback(feedback: DataFrame, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Per day: orders, mean rates and time, confirm and modify rate, mean number of corrections; recent days if asked."""
    if as_of is not None:
        feedback = feedback.where(F.col("order_date") >= F.date_sub(F.lit(as_of).cast("date"), days or 7))
    n = F.count(F.lit(1))
    return feedback.groupBy("order_date").agg(
        n.alias("total_orders"), round_half_up(F.avg("store_match_rate"), 6).alias("avg_store_match_rate"),
        round_half_up(F.avg("sku_match_rate"), 6).alias("avg_sku_match_rate"),
        round_half_up(F.avg("processing_time_ms"), 4).alias("avg_processing_time_ms"),
        round_half_up(F.count_if("user_confirmed") / n, 6).alias("confirm_rate"),
        round_half_up(F.count_if("user_modified") / n, 6).alias("modify_rate"),
        round_half_up(F.avg(json_length(F.col("corrections"))), 6).alias("avg_corrections"))


def correction_rows(feedback: DataFrame, key: str = "feedback_id", body: str = "corrections") -> DataFrame:
    """One row per entry of the corrections array, with defaults."""
    c = feedback.select(key, F.posexplode(F.from_json(body, CORRECTIONS)).alias("pos", "c"))
    return c.select(
        key, F.col("pos").cast("bigint").alias("pos"), F.coalesce("c.type", F.lit("unknown")).alias("correction_type"),
        F.coalesce("c.original_name", "c.original", F.lit("")).alias("entity_name"),
        F.coalesce("c.original", F.lit("")).alias("original_value"), F.coalesce("c.corrected", F.lit("")).alias("corrected_value"),
        F.coalesce("c.match_layer", F.lit("")).alias("match_layer"), F.coalesce("c.match_score", F.lit(0.0)).alias("match_score"),
        F.coalesce("c.auto_matched", F.lit(True)).alias("auto_matched"))


def layer_counts(outcomes: DataFrame) -> DataFrame:
    """Mergeable layer statistics of (entity_type, layer_name, match_score, confirmed) rows."""
    return outcomes.groupBy("entity_type", "layer_name").agg(
        F.count(F.lit(1)).alias("total_attempts"), F.count_if("confirmed").alias("success_count"),
        F.count_if(~F.col("confirmed")).alias("user_corrected_count"), F.sum("match_score").alias("score_sum"))


def merge_layer_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent and accumulate: old and new counts added up by key."""
    return old.unionByName(new).groupBy("entity_type", "layer_name").agg(*[
        F.sum(c).alias(c) for c in ("total_attempts", "success_count", "user_corrected_count", "score_sum")])


def layer_rates(counts: DataFrame) -> DataFrame:
    n = F.col("total_attempts")
    return counts.select(
        "entity_type", "layer_name", "total_attempts", "success_count", "user_corrected_count",
        round_half_up(F.when(n > 0, F.col("success_count") / n).otherwise(0.0), 4).alias("success_rate"),
        round_half_up(F.when(n > 0, F.col("score_sum") / n).otherwise(0.0), 4).alias("avg_match_score"))


def layer_report(counts: DataFrame, min_attempts: int = fv.LAYER_MIN_ATTEMPTS) -> DataFrame:
    return layer_rates(counts).where(F.col("total_attempts") >= min_attempts).orderBy("entity_type", "success_rate")


def alias_candidates(corrections: DataFrame, as_of: str, days: int = fv.ALIAS_LOOKBACK_DAYS, min_count: int = fv.ALIAS_MIN_COUNT,
                     k: int | None = fv.ALIAS_TOP, until_as_of: bool = False) -> DataFrame:
    """Frequent (name, corrected value) pairs of type sku in the days before a date; the k most frequent (a report limit)."""
    day = F.lit(as_of).cast("date")
    rows = corrections.where((F.col("correction_type") == "sku") & (F.col("created_at") >= F.date_sub(day, days)))
    if until_as_of:
        rows = rows.where(F.col("created_at") < day)
    out = rows.groupBy("entity_name", "corrected_value").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)
    return out if k is None else out.orderBy(F.col("cnt").desc(), "entity_name", "corrected_value").limit(k)


def daily_alias_summary(corrections: DataFrame, as_of: str, days: int = fv.DAILY_ALIAS_DAYS, min_count: int = fv.DAILY_ALIAS_MIN) -> DataFrame:
    return alias_candidates(corrections, as_of, days, min_count, None, until_as_of=True)


def threshold_tuning(corrections: DataFrame, as_of: str, days: int = fv.TUNING_LOOKBACK_DAYS, min_total: int = fv.TUNING_MIN_TOTAL,
                     flag: float = fv.TUNING_FLAG_PERCENT) -> DataFrame:
    rows = corrections.where(F.col("created_at") >= F.date_sub(F.lit(as_of).cast("date"), days))
    out = rows.groupBy("match_layer").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("auto_matched").alias("confirmed"), F.count_if(~F.col("auto_matched")).alias("corrected"))
    rate = round_half_up(F.try_divide(F.col("corrected"), F.col("total")) * 100, 2)
    return out.where(F.col("total") >= min_total).withColumn("correction_rate", rate).withColumn("flagged", F.col("correction_rate") > flag)


def feedback_record(review: DataFrame, stores: DataFrame, key: str = "order_id") -> DataFrame:
    """Feedback record per order: counts and rates of lines and stores, kinds of open alerts as JSON.

    review: key, matched, confidence; stores: key, confirmed (boolean).
    """
    lines = review.groupBy(key).agg(
        F.count(F.lit(1)).alias("sku_count"), F.count_if("matched").alias("matched_sku_count"),
        F.array_sort(F.collect_set(F.when(~F.col("matched"), "unmatched").when(F.col("confidence") < 0.8, "low_confidence"))).alias("_kinds"))
    shops = stores.groupBy(key).agg(F.count(F.lit(1)).alias("store_count"), F.count_if("confirmed").alias("matched_store_count"))
    return lines.join(shops, key, "left").select(
        key, "sku_count", "matched_sku_count", F.coalesce("store_count", F.lit(0)).alias("store_count"),
        F.coalesce("matched_store_count", F.lit(0)).alias("matched_store_count"),
        round_half_up(F.col("matched_sku_count") / F.col("sku_count"), 6).alias("sku_match_rate"),
        round_half_up(F.coalesce(F.try_divide(F.col("matched_store_count"), F.col("store_count")), F.lit(0.0)), 6).alias("store_match_rate"),
        F.to_json("_kinds").alias("alerts"))


VERSION_METRICS = [
    "total_orders", "total_sku_items", "matched_sku_items", "overall_sku_match_rate", "avg_sku_match_rate", "perfect_match_orders",
    "total_store_items", "matched_store_items", "overall_store_match_rate", "avg_store_match_rate",
    "user_confirmed_count", "user_confirmed_rate", "user_modified_count", "user_modified_rate", "total_corrections",
    "avg_corrections_per_order", "orders_with_corrections", "avg_processing_time_ms",
]


def version_metrics(feedback: DataFrame, corrections: DataFrame, version: str = "skill_version", key: str = "feedback_id") -> DataFrame:
    """Quality metrics per version; rates in percent."""
    n = F.count(F.lit(1))
    base = feedback.groupBy(version).agg(
        n.alias("total_orders"), F.sum("sku_count").alias("total_sku_items"), F.sum("matched_sku_count").alias("matched_sku_items"),
        F.avg("sku_match_rate").alias("_sku"), F.count_if(F.col("sku_match_rate") >= 1.0).alias("perfect_match_orders"),
        F.sum("store_count").cast("bigint").alias("total_store_items"), F.sum("matched_store_count").cast("bigint").alias("matched_store_items"),
        F.avg("store_match_rate").alias("_store"), F.count_if("user_confirmed").alias("user_confirmed_count"),
        F.count_if("user_modified").alias("user_modified_count"), F.avg("processing_time_ms").alias("_ms"))
    per_order = corrections.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    corrected = feedback.select(key, version).join(per_order, key).groupBy(version).agg(
        F.sum("_c").alias("total_corrections"), F.count(F.lit(1)).alias("orders_with_corrections"))
    m = base.join(corrected, version, "left")

    def pct(a: str, b: str) -> Column:
        return round_half_up(F.coalesce(F.try_divide(F.col(a), F.col(b)) * 100, F.lit(0.0)), 4)

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)

    return m.select(
        version, "total_orders", whole("total_sku_items"), whole("matched_sku_items"),
        pct("matched_sku_items", "total_sku_items").alias("overall_sku_match_rate"), round_half_up(F.col("_sku") * 100, 4).alias("avg_sku_match_rate"),
        "perfect_match_orders", whole("total_store_items"), whole("matched_store_items"),
        pct("matched_store_items", "total_store_items").alias("overall_store_match_rate"), round_half_up(F.col("_store") * 100, 4).alias("avg_store_match_rate"),
        "user_confirmed_count", pct("user_confirmed_count", "total_orders").alias("user_confirmed_rate"),
        "user_modified_count", pct("user_modified_count", "total_orders").alias("user_modified_rate"), whole("total_corrections"),
        round_half_up(F.coalesce(F.col("total_corrections"), F.lit(0)) / F.col("total_orders"), 6).alias("avg_corrections_per_order"),
        whole("orders_with_corrections"), round_half_up(F.col("_ms"), 2).alias("avg_processing_time_ms"))


def corrections_by_type(feedback: DataFrame, corrections: DataFrame, version: str = "skill_version", key: str = "feedback_id") -> DataFrame:
    kinds = corrections.groupBy(key, F.coalesce("correction_type", F.lit("unknown")).alias("correction_type")).agg(F.count(F.lit(1)).alias("n"))
    return feedback.select(key, version).join(kinds, key).groupBy(version, "correction_type").agg(F.sum("n").alias("n"))


def long_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def version_delta(metrics: DataFrame, old: str, new: str, version: str = "skill_version") -> DataFrame:
    """Per metric: old value, new value, difference and change in percent (null where the old value is 0)."""
    lm = long_metrics(metrics, [version], VERSION_METRICS)
    per = lm.groupBy("metric").agg(
        F.max(F.when(F.col(version) == old, F.col("value"))).alias("old_value"), F.max(F.when(F.col(version) == new, F.col("value"))).alias("new_value"))
    diff = F.col("new_value") - F.col("old_value")
    return per.withColumn("diff", round_half_up(diff, 4)).withColumn(
        "pct_change", F.when(F.col("old_value") != 0, round_half_up(diff / F.col("old_value") * 100, 2)))


def corrections_delta(by_type: DataFrame, old: str, new: str, version: str = "skill_version") -> DataFrame:
    """Corrections by type in two versions, types of either."""
    a = by_type.where(F.col(version) == old).select("correction_type", F.col("n").alias("old_n"))
    b = by_type.where(F.col(version) == new).select("correction_type", F.col("n").alias("new_n"))
    return a.join(b, "correction_type", "full_outer").select(
        "correction_type", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))


def daily_wrap(feedback: DataFrame, keys: Sequence[str] = ("order_date",), owner: str | None = None) -> DataFrame:
    """Daily wrap in long form (metric, value), one aggregation for all metrics."""
    rows = feedback if owner is None else feedback.where(F.col("owner_code") == owner)
    wide = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders_total"), F.count_distinct("owner_code").alias("distinct_owners"),
        F.count_if(F.col("user_confirmed") & ~F.col("user_modified")).alias("auto_confirmed"), F.count_if("user_modified").alias("user_modified"),
        round_half_up(F.avg(F.when(F.col("sku_count") > 0, F.col("sku_match_rate"))), 3).alias("avg_sku_match_rate"),
        round_half_up(F.avg("processing_time_ms"), 0).alias("avg_processing_ms"), F.sum("sku_count").alias("total_skus"),
        F.sum(json_length(F.col("alerts"))).alias("total_alert_entries"))
    names = [c for c in wide.columns if c not in keys]
    return long_metrics(wide, keys, names)


def continuity(records: DataFrame, source: str, ts: str, as_of: str, warn_hours: int = 24, stop_hours: int = 72) -> DataFrame:
    """Hours from the newest record of each source to a given moment: OK, WARN or P0."""
    newest = records.groupBy(source).agg(F.max(ts).alias("newest"))
    seconds = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.col("newest").cast("timestamp"))
    hours = F.floor(seconds / 3600).cast("bigint")
    return newest.select(source, hours.alias("gap_hours"), F.when(hours > stop_hours, "P0").when(hours > warn_hours, "WARN").otherwise("OK").alias("status"))


# --- text index -----------------------------------------------------------------------------

def inverted_index(tokens: DataFrame, key: str, token: str = "token") -> DataFrame:
    """token → number of documents; the postings stay in long form (token, document), which no hot token can outgrow."""
    return tokens.select(token, key).distinct().groupBy(token).agg(F.count(F.lit(1)).alias("n_docs"))


def document_entries(docs: DataFrame, key: str, text: str, tokens: Column, first: int | None = None) -> DataFrame:
    """Per document: its tokens (all, or as many as an entry shows), size in bytes, content hash."""
    return docs.select(key, (tokens if first is None else F.slice(tokens, 1, first)).alias("keywords"), F.octet_length(text).cast("bigint").alias("size"),
                       F.left(F.md5(text), F.lit(8)).alias("hash"))


def search_index(tokens: DataFrame, sizes: DataFrame, key: str, word: str, k: int = 10) -> DataFrame:
    """Documents with a token that contains the word, largest first, the first k (a report limit)."""
    hits = tokens.where(F.lower("token").contains(word.lower())).select(key).distinct()
    return hits.join(sizes, key).orderBy(F.col("size").desc(), key).limit(k)


def index_difference(current: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Documents only in the current set ('new') and only in the index ('removed')."""
    new = current.select(key).join(indexed.select(key), key, "left_anti").withColumn("state", F.lit("new"))
    removed = indexed.select(key).join(current.select(key), key, "left_anti").withColumn("state", F.lit("removed"))
    return new.unionByName(removed).distinct()


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """First arrival per key."""
    named = df
    names = []
    for i, k in enumerate(keys):
        named = named.withColumn(f"_k{i}", k)
        names.append(f"_k{i}")
    from .ranking import first_per_key

    return first_per_key(named, names, order).drop(*names)


def name_key(c: Column, keep: int | None = None) -> Column:
    """Letters, digits and CJK of a title, whole unless a length is given."""
    key = F.regexp_replace(c, r"[^一-龥a-zA-Z0-9]", "")
    return key if keep is None else F.left(key, F.lit(keep))
