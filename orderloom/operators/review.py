"""Review table, alerts, choices of people, edits, and the outbound order table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .ranking import first_per_key


def review_table(matched: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Matched and unmatched lines in one table (order by line at the place of use)."""
    return matched.withColumn("matched", F.lit(True)).unionByName(
        unmatched.withColumn("matched", F.lit(False)), allowMissingColumns=True)


def line_alerts(matched: Column, confidence: Column, unit: Column, floor: float = 0.8) -> Column:
    """Alert kinds of one line: low_confidence, unmatched, empty_field."""
    return F.array_compact(F.array(
        F.when(matched & (confidence < floor), F.lit("low_confidence")),
        F.when(~matched, F.lit("unmatched")),
        F.when(matched & (F.coalesce(unit, F.lit("")) == ""), F.lit("empty_field"))))


def review_alerts(review: DataFrame, keys: Sequence[str], unit: str = "sku_unit") -> DataFrame:
    """One row per alert with its severity; unmatched lines and empty fields are critical."""
    rows = review.select(*keys, F.explode(line_alerts(F.col("matched"), F.col("confidence"), F.col(unit))).alias("alert"))
    return rows.withColumn("severity", F.when(F.col("alert") == "low_confidence", "warning").otherwise("critical"))


def review_summary(review: DataFrame, keys: Sequence[str], unit: str = "sku_unit") -> DataFrame:
    """Per order (or store): items, matched, unmatched, alerts, critical flag."""
    alerts = line_alerts(F.col("matched"), F.col("confidence"), F.col(unit))
    critical = F.arrays_overlap(alerts, F.array(F.lit("unmatched"), F.lit("empty_field")))
    return review.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if("matched").alias("matched_count"),
        F.count_if(~F.col("matched")).alias("unmatched_count"), F.sum(F.size(alerts)).cast("bigint").alias("alert_count"),
        F.coalesce(F.max(critical), F.lit(False)).alias("has_critical_alerts"))


def multi_summary(review: DataFrame, keys: Sequence[str], floor: float = 0.8) -> DataFrame:
    """Summary over all stores of an order; only confident lines count as matched here."""
    low = ~F.col("matched") | (F.col("confidence") < floor)
    return review.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(~low).alias("matched_count"),
        F.count_if(F.col("matched") & low).alias("alert_count"), F.count_if(~F.col("matched")).alias("unmatched_count"))


def apply_choices(review: DataFrame, choices: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Apply chosen codes to lines: fills unmatched ones, updates the others.

    choices: keys, new_sku, new_unit, new_unit_type, new_quantity, seq. Out: applied (all lines), failed (choices that lack
    a key or code, or fit no line), open (lines still unmatched, which block the output).
    """
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    complete = complete & (F.coalesce("new_sku", F.lit("")) != "")
    good = first_per_key(choices.where(complete), keys, [F.col("seq").desc()]).drop("seq")
    joined = review.join(good, list(keys), "left")
    chosen = F.col("new_sku").isNotNull()
    applied = joined.select(
        *[c for c in review.columns if c not in ("sku_code", "sku_unit", "unit_type", "quantity", "matched", "confidence", "match_layer")],
        F.when(chosen, F.col("new_sku")).otherwise(F.col("sku_code")).alias("sku_code"),
        F.when(chosen & (F.coalesce("new_unit", F.lit("")) != ""), F.col("new_unit"))
        .when(chosen & ~F.col("matched"), fv.DEFAULT_UNIT).otherwise(F.col("sku_unit")).alias("sku_unit"),
        F.when(chosen & (F.coalesce("new_unit_type", F.lit("")) != ""), F.col("new_unit_type")).otherwise(F.col("unit_type")).alias("unit_type"),
        F.when(chosen & F.col("matched"), F.coalesce("new_quantity", "quantity")).otherwise(F.col("quantity")).alias("quantity"),
        (F.col("matched") | chosen).alias("matched"),
        F.when(chosen & ~F.col("matched"), 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(chosen & ~F.col("matched"), "fill_unmatched").when(chosen, "update_existing").otherwise(F.col("match_layer")).alias("match_layer"))
    lacking = choices.where(~complete).withColumn("reason", F.lit("missing_required_field"))
    lost = choices.where(complete).join(review.select(*keys), list(keys), "left_anti").withColumn("reason", F.lit("not_found"))
    return {"applied": applied, "failed": lacking.unionByName(lost), "open": applied.where("not matched")}


EDITABLE = ["sku_code", "sku_name", "sku_unit", "unit_type", "product_name", "quantity", "product_spec"]


def apply_edits(review: DataFrame, edits: DataFrame, order_key: str, line_key: str, units: DataFrame | None = None,
                fields: Sequence[str] = tuple(EDITABLE)) -> DataFrame:
    """Apply edits (order, row or 0 for all rows, field, new_value, seq); the last edit of a field counts.

    Edits of the unit class also refresh the unit from `units` (owner_code, sku_code, unit), where one is given.
    Edits are spread to columns first, so each line meets one row of all-row edits and one of its own.
    """
    def spread(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[
            F.max(F.when(F.col("field") == f, F.struct("_at", "new_value"))).alias(f"_{tag}_{f}") for f in fields])

    edits = edits.withColumnRenamed("seq", "_at")
    own = spread(edits.where("row > 0").withColumnRenamed("row", line_key), [order_key, line_key], "own")
    every = spread(edits.where("row = 0"), [order_key], "all")
    joined = review.join(own, [order_key, line_key], "left").join(every, order_key, "left")
    out = joined
    for f in fields:
        if f not in review.columns:
            continue
        last = F.greatest(F.col(f"_own_{f}"), F.col(f"_all_{f}"))
        value = last["new_value"]
        kind = dict(review.dtypes)[f]
        new = value if kind == "string" else value.try_cast(kind)
        out = out.withColumn(f, F.coalesce(new, F.col(f)))
        if f == "unit_type" and units is not None:
            out = out.withColumn("_unit_edit", last.isNotNull() & F.col("matched"))
    if units is not None:
        u = units.select("owner_code", "sku_code", F.col("unit").alias("_unit"))
        out = out.join(u, ["owner_code", "sku_code"], "left").withColumn(
            "sku_unit", F.when(F.col("_unit_edit"), F.coalesce("_unit", F.lit(fv.DEFAULT_UNIT))).otherwise(F.col("sku_unit")))
    return out.select(*review.columns)


def outbound_table(lines: DataFrame, columns: Sequence[str] = fv.OUTBOUND_COLUMNS, defaults: dict = fv.OUTBOUND_DEFAULTS) -> DataFrame:
    """The fixed outbound columns of matched lines; columns the lines lack get their default."""
    have = set(lines.columns)
    return lines.select(*[
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(defaults.get(c, ""))).alias(c) for c in columns])


def write_outbound(table: DataFrame, path: str, order_key: str = "third_order_no", fmt: str = "csv", files: int | None = None) -> None:
    """An outbound table as files of ranges of orders: all rows of an order stand together in one file, in their sequence.

    files: how many, by default as many as Spark shuffles into; a table is never gathered in one task.
    """
    keys = [F.col(order_key)]
    dealt = table.repartitionByRange(files, *keys) if files else table.repartitionByRange(*keys)
    writer = dealt.sortWithinPartitions(order_key, "store_code", F.col("seq_no").try_cast("bigint")).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_outbound(df: DataFrame) -> DataFrame:
    """(order, seq, store, sku, unit class, quantity) of an outbound table."""
    return df.select(
        F.col("third_order_no").alias("order_no"), F.col("seq_no").cast("bigint").alias("seq"), "store_code", "sku_code",
        "unit_type", F.col("quantity").try_cast("bigint").alias("quantity"))
