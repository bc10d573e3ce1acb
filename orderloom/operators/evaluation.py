"""Comparison of results with known truth, and of old with new outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up


def sku_truth(results: DataFrame, expected_sku: str = "true_sku", expected_unit_type: str = "true_unit_type") -> DataFrame:
    """Adds sku_hit, unit_hit, unmatched and the need for confirmation to lines that carry their truth."""
    return results.where(F.coalesce(expected_sku, F.lit("")) != "").select(
        "*", F.coalesce(F.col("sku_code") == F.col(expected_sku), F.lit(False)).alias("sku_hit"),
        (F.coalesce(F.col(expected_unit_type), F.lit("")) != "").alias("has_unit_truth"),
        F.coalesce((F.col(expected_unit_type) != "") & (F.col("unit_type") == F.col(expected_unit_type)), F.lit(False)).alias("unit_hit"),
        (~F.col("matched")).alias("unmatched"))


def join_truth(results: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truth rows (keys, true_sku, true_unit_type) with their result; lines the run lost count as unmatched."""
    cols = [c for c in ("sku_code", "unit_type", "matched", "need_confirm", "confidence") if c in results.columns]
    joined = truth.join(results.select(*keys, *cols), list(keys), "left")
    return sku_truth(joined.withColumn("matched", F.coalesce("matched", F.lit(False))).withColumn("need_confirm", F.coalesce("need_confirm", F.lit(False))))


def accuracy_totals(checked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hit, unit, confirmation and unmatched shares in percent per test set."""
    n = F.count(F.lit(1))

    def pct(a, b):
        return round_half_up(F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0)), 2)

    return checked.groupBy(*keys).agg(
        n.alias("total"), F.count_if("sku_hit").alias("sku_hits"), pct(F.count_if("sku_hit"), n).alias("sku_hit_pct"),
        F.count_if("has_unit_truth").alias("unit_total"), pct(F.count_if("unit_hit"), F.count_if("has_unit_truth")).alias("unit_hit_pct"),
        pct(F.count_if("need_confirm"), n).alias("confirm_pct"), pct(F.count_if("unmatched"), n).alias("unmatched_pct"))


def confidence_bands(results: DataFrame) -> DataFrame:
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    return results.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def store_truth(results: DataFrame, truth: DataFrame, stores: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Store, owner and warehouse hits. results: request_id, store_code; truth: request_id, true_store."""
    facts = stores.select("store_code", "owner_code", "warehouse").join(
        warehouses.select(F.col("warehouse_name").alias("warehouse"), "warehouse_code"), "warehouse", "left")
    want = facts.select(F.col("store_code").alias("true_store"), F.col("owner_code").alias("true_owner"),
                        F.coalesce("warehouse_code", F.lit("")).alias("true_wh"))
    got = facts.select("store_code", F.col("owner_code").alias("got_owner"), F.coalesce("warehouse_code", F.lit("")).alias("got_wh"))
    # only rows with a store look it up: requests without one would all meet on the null code, in one task
    found = results.where("store_code is not null").select("request_id", "store_code").join(got, "store_code", "left")
    j = truth.join(found, "request_id", "left").join(want, "true_store", "left")
    no = F.lit(False)
    return j.select(
        "request_id", F.coalesce(F.col("store_code") == F.col("true_store"), no).alias("store_hit"),
        F.coalesce(F.col("got_owner") == F.col("true_owner"), no).alias("owner_hit"), (F.col("true_wh") != "").alias("has_warehouse"),
        F.coalesce((F.col("true_wh") != "") & (F.col("got_wh") == F.col("true_wh")), no).alias("warehouse_hit"))


def replay_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer comparison of two outputs by line; match is null where one side has no code."""
    a = old.select(*keys, F.col("sku_code").alias("old_sku"), F.col("unit_type").alias("old_unit_type"), F.col("quantity").alias("old_qty"))
    b = new.select(*keys, F.col("sku_code").alias("new_sku"), F.col("unit_type").alias("new_unit_type"), F.col("quantity").alias("new_qty"))
    both = (F.coalesce("old_sku", F.lit("")) != "") & (F.coalesce("new_sku", F.lit("")) != "")
    return a.join(b, list(keys), "full_outer").withColumn("match", F.when(both, F.col("old_sku") == F.col("new_sku")))


def replay_status(diff: DataFrame, order_key: str) -> DataFrame:
    """Per order: compared, no_old_output or no_new_output, with its counts."""
    per = diff.groupBy(order_key).agg(
        F.count_if(F.col("match").isNotNull()).alias("compared"), F.count_if("match").alias("consistent"),
        F.count("old_sku").alias("_old"), F.count("new_sku").alias("_new"))
    status = F.when(F.col("_old") == 0, "no_old_output").when(F.col("_new") == 0, "no_new_output").otherwise("compared")
    return per.select(order_key, status.alias("status"), "compared", "consistent")


def replay_totals(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("compared").alias("items_compared"), F.sum("consistent").alias("items_consistent"),
        round_half_up(F.coalesce(F.try_divide(F.sum("consistent") * 100.0, F.sum("compared")), F.lit(0.0)), 1).alias("accuracy_pct"))
