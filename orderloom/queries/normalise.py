"""Documents, rule sets and sheets."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import normalise as nm
from ..operators.ordered import fill_forward
from . import query

DOC = """CASE WHEN o_orderkey % 4 = 3 THEN concat('{"store_name":"河北-店', o_orderkey, '","phone":"139', o_custkey, '","items":[{"product_name":" 果 糖 ","quantity":"', o_custkey % 7, '件","unit":"箱"}]}')
  ELSE concat('{"stores":{"A', o_orderkey, '":{"store_name":"天津-A', o_orderkey, '","phone":"12345","items":[{"product_name":"椰果","quantity":"', o_custkey % 5, '"},{"product_name":"","quantity":"3"},{"product_name":"茶 ","quantity":"2.7","unit":"","seq":9}]},"B":{"items":[]}}}') END"""
STORES_SQL = """SELECT o_orderkey, concat('河北-店', o_orderkey) AS store_key, concat('店', o_orderkey) AS store_name, concat('139', o_custkey) AS phone, 1 AS n_items FROM orders WHERE o_orderkey % 4 = 3
  UNION ALL SELECT o_orderkey, concat('A', o_orderkey), concat('A', o_orderkey), '12345', 3 FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, 'B', 'B', '', 0 FROM orders WHERE o_orderkey % 4 <> 3"""
ITEMS_SQL = """SELECT o_orderkey, concat('店', o_orderkey) AS store_name, 1 AS seq, '果糖' AS product_name, '箱' AS unit, o_custkey % 7 AS quantity FROM orders WHERE o_orderkey % 4 = 3
  UNION ALL SELECT o_orderkey, concat('A', o_orderkey), 1, '椰果', '件', o_custkey % 5 FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, concat('A', o_orderkey), 9, '茶', '件', 2 FROM orders WHERE o_orderkey % 4 <> 3"""


def doc_stores(t):
    return nm.document_stores(t.orders.select("o_orderkey", F.expr(DOC).alias("doc")), "o_orderkey")


@query("n01_document_stores", f"SELECT o_orderkey, store_key, store_name, phone, n_items::BIGINT AS n_items FROM ({STORES_SQL}) x")
def _(t):
    return doc_stores(t).select("o_orderkey", "store_key", "store_name", "phone", F.size("items").cast("bigint").alias("n_items"))


@query("n01_document_items", f"SELECT o_orderkey, store_name, seq::BIGINT AS seq, product_name, unit, quantity::BIGINT AS quantity FROM ({ITEMS_SQL}) x")
def _(t):
    return nm.document_items(doc_stores(t), "o_orderkey").select("o_orderkey", "store_name", "seq", "product_name", "unit", "quantity")


@query("q01_required_fields", f"SELECT o_orderkey, store_name, seq::BIGINT AS seq, 'bad_quantity' AS error FROM ({ITEMS_SQL}) x WHERE quantity <= 0 UNION ALL SELECT o_orderkey, store_name, 0::BIGINT, 'no_items' FROM ({STORES_SQL}) y WHERE n_items = 0")
def _(t):
    stores = doc_stores(t)
    lines = nm.required_field_errors(nm.document_items(stores, "o_orderkey"), ["o_orderkey", "store_name", "seq"])
    shops = nm.store_errors(stores, "o_orderkey").select("o_orderkey", F.col("store_key").alias("store_name"), F.lit(0).cast("bigint").alias("seq"), "error")
    return lines.unionByName(shops)


@query("q02_validate_document", f"""SELECT o_orderkey, store_name, true AS is_valid, array_to_string(list_filter([CASE WHEN n_items = 0 THEN 'no_items' END, CASE WHEN length(phone) > 0 AND (length(phone) < 7 OR length(phone) > 13) THEN 'odd_phone' END], lambda x: x IS NOT NULL), ',') AS warnings FROM ({STORES_SQL}) x""")
def _(t):
    stores = doc_stores(t).withColumn("n_items", F.size("items")).withColumn("min_quantity", F.lit(0))
    return nm.validate_document(stores).select("o_orderkey", "store_name", "is_valid", F.array_join("warnings", ",").alias("warnings"))


RULES = ", ".join(f"({n}, '{f}', '{a.lower()}')" for n, (f, a) in enumerate((f, a) for f, names in fv.FIELD_ALIASES.items() for a in [f, *names]))
RAW = "CASE event_id % 7 WHEN 0 THEN ' 商品名称 ' WHEN 1 THEN 'QTY' WHEN 2 THEN '备注' WHEN 3 THEN 'Store_Name' WHEN 4 THEN '未知' WHEN 5 THEN '手机' ELSE event_type END"


def rules(t):
    return nm.alias_rules(t.spark)


@query("p36_standard_fields", f"""WITH rules(priority, standard, alias) AS (VALUES {RULES}), b AS (SELECT alias, arg_min(standard, priority) AS standard FROM rules GROUP BY alias)
  SELECT raw_name, b.standard, count(*) AS n FROM (SELECT {RAW} AS raw_name FROM events) e LEFT JOIN b ON b.alias = lower(trim(raw_name)) GROUP BY ALL""")
def _(t):
    names = t.events.select(F.expr(RAW).alias("raw_name")).groupBy("raw_name").agg(F.count(F.lit(1)).alias("n")).withColumn("rule_set", F.lit("default"))
    return nm.standard_field(names, rules(t)).select("raw_name", "standard", "n")


@query("p36_learned_fields", f"""WITH rules(priority, standard, alias) AS (VALUES {RULES}), l AS (SELECT DISTINCT 'remark' AS standard, event_type AS alias FROM events), a AS (SELECT * FROM rules UNION ALL SELECT (SELECT min(priority) FROM rules WHERE standard = 'remark'), standard, alias FROM l),
  b AS (SELECT alias, arg_min(standard, priority) AS standard FROM a GROUP BY alias) SELECT raw_name, b.standard FROM (SELECT DISTINCT {RAW} AS raw_name FROM events) e LEFT JOIN b ON b.alias = lower(trim(raw_name))""")
def _(t):
    learned = t.events.select(F.lit("default").alias("rule_set"), F.lit("remark").alias("standard"), F.col("event_type").alias("alias")).distinct()
    names = t.events.select(F.expr(RAW).alias("raw_name"), F.lit("default").alias("rule_set")).distinct()
    return nm.standard_field(names, nm.learned_rules(rules(t), learned)).select("raw_name", "standard")


@query("p37_rule_set_choice", """SELECT DISTINCT c_mktsegment || '-' || c_nationkey AS owner_name, CASE WHEN c_mktsegment || '-' || c_nationkey IN ('BUILDING-3') THEN 'BUILDING-3' WHEN contains(c_mktsegment, 'BUILD') THEN 'build' WHEN contains(c_mktsegment, 'HOUSE') THEN 'house' ELSE 'default' END AS rule_set FROM customer""")
def _(t):
    owners = t.customer.select(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("owner_name"))
    sets = t.spark.createDataFrame([("build", "BUILD"), ("house", "HOUSE"), ("BUILDING-3", "")], "rule_set string, rule_owner string")
    return nm.choose_rule_set(owners, sets)


@query("a29_rule_inventory", """SELECT p_brand AS rule_set, concat('rules of ', p_brand) AS description, count(DISTINCT p_type) AS field_count FROM part GROUP BY p_brand""")
def _(t):
    r = t.part.select(F.col("p_brand").alias("rule_set"), F.col("p_type").alias("standard"))
    sets = t.part.select(F.col("p_brand").alias("rule_set")).distinct().withColumn("description", F.concat(F.lit("rules of "), "rule_set"))
    return nm.rule_inventory(r, sets)


CELLS = ("sheet_cells",)


@query("s07_layouts", "SELECT DISTINCT doc_id, CASE cast(floor(doc_id / 10) AS bigint) % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'outbound' WHEN 2 THEN 'ordering' ELSE 'unknown' END AS layout FROM sheet_cells", CELLS)
def _(t):
    return nm.detect_layout(t.sheet_cells)


@query("s07_sheet_lines", """WITH b AS (SELECT p_partkey, p_partkey - p_partkey % 10 AS doc_id, 2 + p_partkey % 10 AS row, cast(floor(p_partkey / 10) AS bigint) % 4 AS k, p_name, p_size, CASE WHEN p_partkey % 4 = 0 THEN concat('店', cast(p_partkey AS varchar)) END AS store FROM part),
  f AS (SELECT *, last_value(store IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS store_name FROM b WHERE k < 3)
  SELECT doc_id, ['standard', 'outbound', 'ordering'][k + 1] AS layout, row, store_name, replace(p_name, ' ', '') AS product_name, CASE k WHEN 1 THEN 1 ELSE p_size END::BIGINT AS quantity, CASE k WHEN 1 THEN '' ELSE '箱' END AS unit, CASE k WHEN 2 THEN '' ELSE concat(cast(p_size AS varchar), 'KG') END AS spec FROM f WHERE store_name IS NOT NULL""")
def _(t):
    return nm.sheet_lines(t.sheet_cells)


@query("w05_fill_forward", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def _(t):
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return fill_forward(rows, ["user_id"], "event_id", "v", "last_purchase", 500).select("event_id", "user_id", "last_purchase")


@query("w10_header_row", f"""WITH rules(priority, standard, alias) AS (VALUES {RULES}), b AS (SELECT alias, arg_min(standard, priority) AS standard FROM rules GROUP BY alias), k AS (SELECT doc_id, row, col, b.standard FROM sheet_cells JOIN b ON b.alias = lower(trim(value)) WHERE row <= 7),
  c AS (SELECT doc_id, row FROM k GROUP BY doc_id, row QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, row) = 1) SELECT k.doc_id, k.row, k.col, k.standard FROM k JOIN c ON c.doc_id = k.doc_id AND c.row = k.row""", CELLS)
def _(t):
    return nm.header_row(t.sheet_cells, rules(t))


def detail_cells(t):
    """Header/detail sheets, one per supplier: label cells, a header row, one line, a total row and a line after it."""
    s = t.supplier
    k, name = F.col("s_suppkey"), F.col("s_name")
    text = k.cast("string")
    grid = [
        (0, 0, F.lit("订单编号：")), (0, 1, F.lit("")), (0, 2, F.concat(F.lit("DH"), text)), (1, 0, F.lit("公司名称")), (1, 1, name), (1, 2, F.lit("联系人")), (1, 3, F.lit("王")),
        (2, 0, F.lit("序号")), (2, 1, F.lit("商品 名称")), (2, 2, F.lit("数量")), (2, 3, F.lit("计量单位")), (3, 0, F.lit("1")), (3, 1, F.lit("椰果")), (3, 2, F.concat((k % 4).cast("string"), F.lit(" 件"))), (3, 3, F.lit("袋")),
        (4, 0, F.lit("2")), (4, 1, F.lit("红茶")), (4, 2, F.lit("5.0")), (4, 3, F.lit("")), (5, 0, F.lit("合计")), (5, 1, F.lit("茶")), (5, 2, F.lit("9")), (6, 0, F.lit("3")), (6, 1, F.lit("late")), (6, 2, F.lit("1"))]
    cells = F.array(*[F.struct(F.lit(r).cast("bigint").alias("row"), F.lit(c).cast("bigint").alias("col"), v.alias("value")) for r, c, v in grid])
    return s.select(k.alias("doc_id"), F.explode(cells).alias("c")).select("doc_id", "c.*")


@query("w11_header_values", "SELECT s_suppkey AS doc_id, concat('DH', cast(s_suppkey AS varchar)) AS order_no, s_name AS store_name, '王' AS contact_person FROM supplier")
def _(t):
    return nm.label_values(detail_cells(t)).select("doc_id", "order_no", "store_name", "contact_person")


@query("w11_detail_lines", "SELECT s_suppkey AS doc_id, '椰果' AS product_name, s_suppkey % 4 AS quantity, '袋' AS unit FROM supplier WHERE s_suppkey % 4 > 0 UNION ALL SELECT s_suppkey, '红茶', 5, '件' FROM supplier")
def _(t):
    return nm.header_detail_lines(detail_cells(t), rules(t)).select("doc_id", "product_name", "quantity", "unit")


@query("q09_table_rules", """SELECT p_partkey, 'p_size' AS field, 'min' AS rule FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, 'p_size', 'max' FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'p_type', 'enum' FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')
  UNION ALL SELECT p_partkey, 'p_name', 'pattern' FROM part WHERE NOT regexp_matches(p_name, '^[a-z]+ [a-z]+t$') UNION ALL SELECT p_partkey, 'p_name', 'maxLength' FROM part WHERE length(p_name) > 10 UNION ALL SELECT p_partkey, 'p_brand', 'type' FROM part""")
def _(t):
    return nm.table_rules(t.part, ["p_partkey"], [
        {"field": "p_size", "type": "number", "required": True, "min": 5, "max": 45}, {"field": "p_type", "type": "string", "enum": ["ECONOMY", "SMALL"]},
        {"field": "p_name", "required": True, "pattern": "^[a-z]+ [a-z]+t$", "maxLength": 10}, {"field": "p_brand", "type": "number"}])
