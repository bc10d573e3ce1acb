"""Sources and sinks. Files go below the shared folder of the session."""

from pyspark.sql import functions as F

from ..session import work_path
from ..sources import io
from . import query

TRUTH_DOC = """concat('{"source":"o', o_orderkey, '","stores":{"S1":{"name":"S1","items":[{"name":"a","qty":', o_custkey, ',"unit":"箱"},{"name":"b","qty":2,"unit":"件"}]},"S2":{"name":"S2","items":[{"name":"c","qty":3,"unit":"件"}]}},"ground_truth":{"1":[{"sku":"SK', o_custkey, '","unit_type":"large"}],"3":[{"sku":"SK3","unit_type":""}]}}')"""


@query("s06_truth_documents", """SELECT concat('o', cast(o_orderkey AS varchar)) AS source, CASE WHEN n < 3 THEN 'S1' ELSE 'S2' END AS store_name, n AS line_no, ['a', 'b', 'c'][n] AS product_name, CASE n WHEN 1 THEN o_custkey ELSE n END AS quantity,
  CASE n WHEN 1 THEN concat('SK', cast(o_custkey AS varchar)) WHEN 3 THEN 'SK3' END AS true_sku, CASE n WHEN 1 THEN 'large' WHEN 3 THEN '' END AS true_unit_type FROM (SELECT o_orderkey, o_custkey, unnest(range(1, 4)) AS n FROM orders) x""")
def _(t):
    docs = t.orders.select(F.from_json(F.expr(TRUTH_DOC), io.TRUTH_SCHEMA).alias("d")).select("d.*")
    return io.truth_items(docs).drop("unit")


@query("s08_csv_round_trip", "SELECT warehouse_name, warehouse_code FROM warehouses WHERE warehouse_code <> ''", ("warehouses",))
def _(t):
    path = work_path(t.spark, "csv")
    io.write_csv(t.warehouses.where("warehouse_code <> ''"), path)
    return io.read_csv(t.spark, path, "warehouse_name string, warehouse_code string")


@query("s11_append", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL")
def _(t):
    path = work_path(t.spark, "append")
    for kind in ("click", "error"):
        io.append(t.events.where(F.col("event_type") == kind).select("event_id", "event_type"), path, "event_type")
    return t.spark.read.parquet(path).groupBy(F.col("event_type").cast("string").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("s14_export_manifest", "SELECT 'catalog' AS table_name, count(*) AS row_count FROM part UNION ALL SELECT 'stores', count(*) FROM customer UNION ALL SELECT 'warehouses', count(*) FROM warehouses", ("warehouses",))
def _(t):
    return io.export_tables({"catalog": t.catalog, "stores": t.stores, "warehouses": t.warehouses}, work_path(t.spark, "export"))


@query("s14_manifest_totals", "SELECT 2 AS n_tables, (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) AS total_rows")
def _(t):
    return io.manifest({"catalog": t.catalog, "stores": t.stores}).agg(F.count(F.lit(1)).alias("n_tables"), F.sum("row_count").alias("total_rows")).withColumn("n_tables", F.col("n_tables").cast("int"))
