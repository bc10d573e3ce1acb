"""From nested order documents and sheet cells to order lines; rule sets; validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from .ordered import fill_forward

ITEM = "struct<product_name:string,spec:string,unit:string,quantity:string,remark:string,product_code:string,seq:int>"
STORE = f"struct<store_name:string,contact_person:string,phone:string,address:string,order_no:string,items:array<{ITEM}>>"
DOCUMENT = (
    f"struct<stores:map<string,{STORE}>,store_name:string,contact_person:string,phone:string,address:string,"
    f"order_no:string,items:array<{ITEM}>>")


# --- nested documents -----------------------------------------------------------------------

def document_stores(docs: DataFrame, key: str, body: str = "doc", region_prefixes: Sequence[str] = fv.REGION_PREFIXES) -> DataFrame:
    """One row per store of each JSON order document; a document with one bare store counts as a map of one."""
    d = docs.select(key, F.from_json(body, DOCUMENT).alias("d"))
    single = F.struct(*[F.col(f"d.{f}").alias(f) for f in ("store_name", "contact_person", "phone", "address", "order_no", "items")])
    stores = F.when(F.size(F.coalesce("d.stores", F.create_map().cast(f"map<string,{STORE}>"))) > 0, F.col("d.stores")).when(
        F.coalesce("d.store_name", F.lit("")) != "", F.create_map(F.col("d.store_name"), single))
    rows = d.select(key, F.explode(stores).alias("store_key", "s"))
    return rows.select(
        key, "store_key", tx.strip_first_prefix(F.coalesce("s.store_name", "store_key"), region_prefixes).alias("store_name"),
        *[F.coalesce(f"s.{f}", F.lit("")).alias(f) for f in ("contact_person", "phone", "address", "order_no")], F.col("s.items").alias("items"))


def document_items(stores: DataFrame, key: str) -> DataFrame:
    """One row per item with cleaned values; items without a product name are dropped."""
    rows = stores.select(key, "store_key", "store_name", F.posexplode("items").alias("pos", "i"))
    named = rows.where(~F.coalesce("i.product_name", F.lit("")).isin("", "nan"))
    return named.select(
        key, "store_key", "store_name", F.coalesce("i.seq", F.col("pos") + 1).cast("bigint").alias("seq"),
        tx.scrub("i.product_name").alias("product_name"), tx.scrub("i.spec").alias("spec"),
        tx.scrub(tx.first_non_empty("i.unit", default=fv.DEFAULT_UNIT)).alias("unit"),
        tx.safe_int(F.coalesce("i.quantity", F.lit("0"))).alias("quantity"), tx.scrub("i.remark").alias("remark"),
        tx.strip(F.coalesce("i.product_code", F.lit(""))).alias("product_code"))


def required_field_errors(items: DataFrame, keys: Sequence[str], required: Sequence[str] = fv.REQUIRED_FIELDS) -> DataFrame:
    """One row per broken required-field rule of a line."""
    rules = []
    if "product_name" in required:
        rules.append(F.when(F.coalesce("product_name", F.lit("")) == "", F.lit("missing_product_name")))
    if "quantity" in required:
        rules.append(F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), F.lit("bad_quantity")))
    return items.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("error"))


def store_errors(stores: DataFrame, key: str) -> DataFrame:
    rules = F.array_compact(F.array(
        F.when(F.coalesce("store_name", F.lit("")) == "", F.lit("missing_store_name")),
        F.when(F.coalesce(F.size("items"), F.lit(0)) <= 0, F.lit("no_items"))))
    return stores.select(key, "store_key", F.explode(rules).alias("error"))


def validate_document(stores: DataFrame) -> DataFrame:
    """Adds is_valid, warnings and errors: store name, items, phone length 7-13, no negative quantity.

    stores: store_name, phone, n_items, min_quantity.
    """
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", ""))
    errors = F.array_compact(F.array(
        F.when(F.coalesce("store_name", F.lit("")) == "", F.lit("missing_store_name")),
        F.when(F.coalesce("min_quantity", F.lit(0)) < 0, F.lit("bad_quantity"))))
    warnings = F.array_compact(F.array(
        F.when(F.coalesce("n_items", F.lit(0)) == 0, F.lit("no_items")),
        F.when((digits > 0) & ((digits < 7) | (digits > 13)), F.lit("odd_phone"))))
    return stores.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("is_valid", F.size("errors") == 0)


# --- column names and rule sets -------------------------------------------------------------------

def alias_rules(spark, aliases: Mapping[str, Sequence[str]] = fv.FIELD_ALIASES, rule_set: str = "default") -> DataFrame:
    """Rule table (rule_set, standard, alias, priority): fields in order, the field's own name first."""
    rows, n = [], 0
    for standard, names in aliases.items():
        for name in [standard, *names]:
            rows.append((rule_set, standard, name.lower(), n))
            n += 1
    return spark.createDataFrame(rows, "rule_set string, standard string, alias string, priority int")


def learned_rules(rules: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned aliases go to the front of their field; names the field already has change nothing.

    learned: rule_set, standard, alias.
    """
    first = rules.groupBy("rule_set", "standard").agg(F.min("priority").alias("_p"))
    new = learned.withColumn("alias", F.lower("alias")).join(
        rules.select("rule_set", "standard", "alias"), ["rule_set", "standard", "alias"], "left_anti")
    placed = new.join(first, ["rule_set", "standard"], "left").select(
        "rule_set", "standard", "alias", F.coalesce("_p", F.lit(1_000_000)).alias("priority"))
    return rules.unionByName(placed)


def standard_field(names: DataFrame, rules: DataFrame, raw: str = "raw_name") -> DataFrame:
    """Standard field of each raw column name, case-insensitive, first rule wins; null where no rule knows it.

    names: rule_set, raw_name. Works on the distinct names; the rule table is small and joined by value.
    """
    best = rules.groupBy("rule_set", "alias").agg(F.min_by("standard", F.struct("priority", "standard")).alias("standard"))
    return names.withColumn("alias", F.lower(tx.strip(raw))).join(best, ["rule_set", "alias"], "left").drop("alias")


def choose_rule_set(owners: DataFrame, rule_sets: DataFrame, default: str = "default") -> DataFrame:
    """Rule set per owner name: its own, else the first (by file name) whose owner name is inside the given one, else default.

    owners: owner_name; rule_sets: rule_set, rule_owner ('' for none).
    """
    from .blocking import containment_join

    asked = owners.select("owner_name").distinct()
    own = asked.join(rule_sets.select(F.col("rule_set").alias("owner_name"), F.col("rule_set").alias("_own")), "owner_name", "left")
    pairs = containment_join(rule_sets.where("rule_owner <> ''").select(F.col("rule_owner").alias("needle")),
                             asked.select(F.col("owner_name").alias("hay")))
    near = pairs.join(rule_sets.withColumnRenamed("rule_owner", "needle"), "needle").groupBy(F.col("hay").alias("owner_name")).agg(
        F.min("rule_set").alias("_near"))
    return own.join(near, "owner_name", "left").select("owner_name", F.coalesce("_own", "_near", F.lit(default)).alias("rule_set"))


def rule_inventory(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """Per rule set: owner name, description and number of standard fields."""
    counts = rules.groupBy("rule_set").agg(F.count_distinct("standard").cast("bigint").alias("field_count"))
    return sets.join(counts, "rule_set", "left").withColumn("field_count", F.coalesce("field_count", F.lit(0)))


# --- sheets as cells (doc_id, row, col, value) -------------------------------------------------------

# Layouts: header cells that must be present, each with the last column it may stand in (None: any), and the column label of each field.
LAYOUTS = [
    ("standard", [("序号", 0), ("门店名称", None), ("商品名称", None)], {"store": "门店名称", "product": "商品名称", "quantity": "数量", "unit": "单位", "spec": "规格"}),
    ("outbound", [("序号", 0), ("门店名称", None), ("产品名称", None)], {"store": "门店名称", "product": "产品名称", "spec": "规格"}),
    ("ordering", [("序号", 0), ("客户名称*", None), ("商品名称*", None)], {"store": "客户名称*", "product": "商品名称*", "quantity": "出库数量*", "unit": "单位"}),
    ("delivery", [("配送明细表", 1)], {"store": "门店", "product": "品名", "quantity": "配送数量", "unit": "单位", "spec": "规格"}),
    ("dated", [("单据日期", 0)], {"store": "往来单位名称", "product": "商品名称", "quantity": "数量", "spec": "规格"}),
]


def detect_layout(cells: DataFrame, layouts=tuple(LAYOUTS)) -> DataFrame:
    """Layout of each sheet from the cells of its first row; 'unknown' where none fits. A mark alone may be part of its cell's text."""
    top = cells.where("row = 1")
    marks = [top.groupBy("doc_id").agg(*[
        F.max(F.when((tx.strip("value").contains(m) if len(need) == 1 else tx.strip("value") == m) & (F.lit(True) if last is None else F.col("col") <= last), 1).otherwise(0)).alias(f"m{j}")
        for j, (m, last) in enumerate(need)]).select("doc_id", F.lit(i).alias("i"), F.lit(name).alias("layout"), sum(
            (F.col(f"m{j}") for j in range(len(need))), F.lit(0)).alias("have"), F.lit(len(need)).alias("need"))
        for i, (name, need, _) in enumerate(layouts)]
    found = marks[0]
    for m in marks[1:]:
        found = found.unionByName(m)
    best = found.where("have = need").groupBy("doc_id").agg(F.min_by("layout", "i").alias("layout"))
    return cells.select("doc_id").distinct().join(best, "doc_id", "left").withColumn("layout", F.coalesce("layout", F.lit("unknown")))


def sheet_lines(cells: DataFrame, layouts=tuple(LAYOUTS), block_rows: int = 100_000) -> DataFrame:
    """Order lines of every sheet with a known layout: header labels give the columns, the store is filled downwards."""
    spark = cells.sparkSession
    labels = spark.createDataFrame(
        [(name, field, label) for name, _, cols in layouts for field, label in cols.items()], "layout string, field string, label string")
    typed = cells.join(detect_layout(cells, layouts), "doc_id").withColumn("value", tx.strip("value"))
    head = typed.join(labels, (typed.layout == labels.layout) & (typed.value == labels.label)).select(
        "doc_id", "row", "col", "field")
    header_row = head.where("field = 'product'").groupBy("doc_id").agg(F.min("row").alias("header_row"))
    columns = head.join(header_row, "doc_id").where("row = header_row").select("doc_id", "col", "field", "header_row")
    values = typed.join(columns, ["doc_id", "col"]).where("row > header_row")
    wide = values.groupBy("doc_id", "layout", "row").agg(*[
        F.max(F.when(F.col("field") == f, F.nullif("value", F.lit("")))).alias(f) for f in ("store", "product", "quantity", "unit", "spec")])
    filled = fill_forward(wide, ["doc_id"], "row", "store", "store_name", block_rows)
    return filled.where("store_name is not null and product is not null").select(
        "doc_id", "layout", "row", "store_name", tx.scrub("product").alias("product_name"),
        F.when(F.col("layout") == "outbound", 1).otherwise(tx.safe_int(F.coalesce("quantity", F.lit("0")))).cast("bigint").alias("quantity"),
        tx.scrub("unit").alias("unit"), tx.scrub("spec").alias("spec"))


def header_row(cells: DataFrame, rules: DataFrame, first_rows: int | None = None) -> DataFrame:
    """Of all or the first rows of each sheet the one with most known field names (the upper one among equals), as (doc_id, row, col, standard)."""
    known = standard_field((cells if first_rows is None else cells.where(F.col("row") <= first_rows)).withColumn("rule_set", F.lit("default")), rules, "value").where(
        "standard is not null")
    counts = known.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("doc_id").agg(F.max_by("row", F.struct("n", (-F.col("row")).alias("up"))).alias("row"))
    return known.join(best, ["doc_id", "row"]).select("doc_id", "row", "col", "standard")


def label_values(cells: DataFrame, labels: Mapping[str, Sequence[str]] = fv.LINE_LABELS) -> DataFrame:
    """Header part of a header/detail sheet: the first non-empty value to the right of a label, the topmost label first."""
    clean = F.regexp_replace(F.coalesce("value", F.lit("")), r"[\s\p{Z}：:]+", "")
    c = cells.withColumn("label", clean).withColumn("value", tx.strip("value"))
    field = None
    for f, words in labels.items():
        field = F.when(F.col("label").isin(*words), f) if field is None else field.when(F.col("label").isin(*words), f)
    at = c.withColumn("field", field).where("field is not null").select("doc_id", "row", F.col("col").alias("at"), "field")
    right = c.where("value <> ''").select("doc_id", "row", "col", "value")
    found = at.join(right, ["doc_id", "row"]).where("col > at").groupBy("doc_id", "row", "at", "field").agg(
        F.min_by("value", "col").alias("value"))
    return found.groupBy("doc_id").agg(*[
        F.coalesce(F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("row", "at"))), F.lit("")).alias(f)
        for f in labels])


NAME_LABELS = ["商品名称", "品名", "货品名称"]
QUANTITY_LABELS = ["数量", "订货数量", "订单数量"]


def header_detail_lines(cells: DataFrame, rules: DataFrame, totals: Sequence[str] = fv.TOTAL_WORDS) -> DataFrame:
    """Detail part of a header/detail sheet: below the first row with name and quantity labels, above the total row."""
    clean = F.regexp_replace(F.coalesce("value", F.lit("")), r"[\s\p{Z}：:]+", "")
    c = cells.withColumn("label", clean).withColumn("value", tx.strip("value"))
    heads = c.groupBy("doc_id", "row").agg(
        F.max(F.col("label").isin(*NAME_LABELS)).alias("has_name"), F.max(F.col("label").isin(*QUANTITY_LABELS)).alias("has_qty"))
    head = heads.where("has_name and has_qty").groupBy("doc_id").agg(F.min("row").alias("head_row"))
    stop_word = F.col("label").startswith(totals[0]) | F.col("label").isin(*totals)
    stops = c.where("col = 0").join(head, "doc_id").where(stop_word & (F.col("row") > F.col("head_row"))).groupBy("doc_id").agg(
        F.min("row").alias("stop_row"))
    head_cells = c.join(head, "doc_id").where("row = head_row and label <> ''").select("doc_id", "col", "head_row", F.col("label").alias("raw"))
    columns = standard_field(head_cells.withColumn("rule_set", F.lit("default")), rules, "raw").where("standard is not null").select(
        "doc_id", "col", "head_row", "standard")
    body = c.join(columns, ["doc_id", "col"]).join(stops, "doc_id", "left").where("row > head_row and (stop_row is null or row < stop_row)")
    fields = ["product_name", "quantity", "unit", "product_spec", "remark"]
    wide = body.groupBy("doc_id", "row").agg(*[F.coalesce(F.max(F.when(F.col("standard") == f, F.col("value"))), F.lit("")).alias(f) for f in fields])
    return wide.withColumn("quantity", tx.first_number("quantity")).where("product_name <> '' and quantity > 0").select(
        "doc_id", "row", "product_name", "quantity", F.when(F.col("unit") == "", fv.DEFAULT_UNIT).otherwise(F.col("unit")).alias("unit"),
        F.col("product_spec").alias("spec"), "remark")


# --- rule-driven validation -----------------------------------------------------------------------------

TYPE_TESTS = {"number": "double", "boolean": "boolean", "date": "date"}


def table_rules(df: DataFrame, keys: Sequence[str], rules: Sequence[Mapping]) -> DataFrame:
    """One row (keys, field, rule) per broken rule. Rules: field, type, required, min, max, minLength, maxLength, pattern, enum."""
    broken: list[Column] = []
    for r in rules:
        f = r["field"]
        text = F.col(f).cast("string")
        absent = F.col(f).isNull() | (text == "")

        def add(name: str, bad: Column, field: str = f) -> None:
            broken.append(F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(name).alias("rule"))))

        if r.get("required"):
            add("required", absent)
        if r.get("type") in TYPE_TESTS:
            add("type", ~absent & text.try_cast(TYPE_TESTS[r["type"]]).isNull())
        number = text.try_cast("double")
        for name, bad in (("min", lambda v: number < v), ("max", lambda v: number > v),
                          ("minLength", lambda v: F.length(text) < v), ("maxLength", lambda v: F.length(text) > v),
                          ("pattern", lambda v: ~text.rlike(v)), ("enum", lambda v: ~text.isin(*v))):
            if name in r:
                add(name, ~absent & F.coalesce(bad(r[name]), F.lit(False)))
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("_b")).select(*keys, "_b.field", "_b.rule")


LINKED_FIELDS = [
    ("delivery_mode", ["专配"], "vehicle_type"), ("delivery_mode", ["市场车", "快递代发"], "advance_pay"),
    ("delivery_mode", ["市场车", "快递代发"], "pay_method"), ("business_type", ["B2C"], "phone"),
    ("business_type", ["B2C"], "address"), ("business_type", ["B2C"], "consumer_courier"),
]


def linked_field_errors(outbound: DataFrame, keys: Sequence[str], rules=tuple(LINKED_FIELDS)) -> DataFrame:
    """Fields of the outbound table that another field's value makes necessary, but that are empty."""
    checks = [F.when(F.col(field).isin(*values) & (F.coalesce(F.col(need).cast("string"), F.lit("")) == ""), F.lit(need))
              for field, values, need in rules]
    return outbound.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("missing_field"))
