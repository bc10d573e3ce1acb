"""Readers and writers of order tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append traces, alerts or corrections, partitioned where a column is named."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_batch(path: str, by: str | None = None):
    """The same as a foreachBatch function; the epoch folder makes a repeated batch overwrite itself."""

    def run(batch: DataFrame, epoch: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/epoch={epoch}")

    return run


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def export_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """Write every table below a folder and return the manifest of what was written."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return manifest({n: spark.read.format(fmt).load(f"{path}/{n}") for n in tables})


DOCUMENT_ITEM = "struct<name:string,qty:bigint,unit:string>"
TRUTH_SCHEMA = (
    "source string, stores map<string, struct<name:string, items:array<" + DOCUMENT_ITEM + ">>>, "
    "ground_truth map<string, array<struct<sku:string, unit_type:string>>>")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True)


def truth_items(docs: DataFrame) -> DataFrame:
    """One row per item with its running number over the stores of the document, and the truth filed under that number.

    Documents are as parsed by TRUTH_SCHEMA. Stores count in name order.
    """
    stores = F.array_sort(F.map_entries("stores"))
    flat = F.flatten(F.transform(stores, lambda e: F.transform(
        e["value"]["items"], lambda i: F.struct(e["key"].alias("store"), i.alias("item")))))
    rows = docs.select("source", "ground_truth", F.posexplode(flat).alias("pos", "x")).withColumn("line_no", (F.col("pos") + 1).cast("bigint"))
    truth = F.get(F.try_element_at("ground_truth", F.col("line_no").cast("string")), F.lit(0))
    return rows.select("source", F.col("x.store").alias("store_name"), "line_no", F.col("x.item.name").alias("product_name"),
                       F.col("x.item.qty").alias("quantity"), F.col("x.item.unit").alias("unit"),
                       truth["sku"].alias("true_sku"), truth["unit_type"].alias("true_unit_type"))
