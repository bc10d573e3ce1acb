"""Store matching queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import store_match as st
from . import query
from .scalars import GRAMS, RATIO

LETTERS = "A-Z"
REQ, STO = ("store_requests",), ("store_requests", "stores")
HIT_COLS = ["request_id", "store_code", "match_type", "need_confirm"]


def ratio_cte(pairs, *before):
    return "WITH RECURSIVE " + ",\n".join([*before, RATIO.format(pairs=pairs)[len("WITH RECURSIVE "):]])


@query("s02_store_scan", "SELECT store_code, store_name, owner_code, phone, warehouse FROM stores WHERE owner_code = 'Brand#3' AND contains(store_name, 'BUILDING')", ("stores",))
def _(t):
    return st.store_scan(t.stores, owner="Brand#3", name_part="BUILDING")


@query("s02_store_by_phone", "SELECT store_code, store_name, owner_code, phone, warehouse FROM stores WHERE phone = '13900000011' OR store_code = 'ST00000005'", ("stores",))
def _(t):
    return st.store_scan(t.stores, phone="13900000011").unionByName(st.store_scan(t.stores, code="ST00000005"))


@query("s02_warehouse_scan", "SELECT warehouse_name, warehouse_code FROM warehouses WHERE warehouse_name = 'NATION_3' AND warehouse_code <> ''", ("warehouses",))
def _(t):
    return st.warehouse_scan(t.warehouses, "NATION_3")


@query("s02_owner_scan", "SELECT customer_id, customer_name FROM owners WHERE status = 'ACTIVE' AND contains(customer_name, 'NATION_1')", ("owners",))
def _(t):
    return st.owner_scan(t.owners, name_part="NATION_1").orderBy("customer_name")


PHONE_PAIRS = "pp AS (SELECT r.request_id, r.store_name AS a, s.store_name AS b, s.store_code, count(*) OVER (PARTITION BY r.request_id) AS n_phone FROM store_requests r JOIN stores s ON s.phone = r.phone WHERE r.phone <> '' AND r.store_name <> '')"


@query("j07_phone_join", ratio_cte("SELECT DISTINCT a, b FROM pp", PHONE_PAIRS) + """, sc AS (SELECT request_id, store_code, n_phone, ratio FROM pp JOIN ratios r ON r.a = pp.a AND r.b = pp.b WHERE ratio >= 0.5),
  be AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM sc QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ratio DESC, store_code) = 1)
  SELECT request_id, store_code, CASE WHEN ratio >= 0.8 THEN 'phone_exact_high_conf' WHEN n_phone > 1 THEN 'phone_exact_multi' ELSE 'phone_exact' END AS match_type, round(ratio, 6) AS similarity, ratio < 0.8 AS need_confirm,
    CASE WHEN ratio < 0.8 AND n_phone > 1 THEN n ELSE 1 END AS n_candidates FROM be WHERE ratio >= 0.75""", STO)
def _(t):
    return st.by_phone(t.store_requests, t.stores).withColumn("similarity", F.round("similarity", 6))


@query("j08_exact_store_name", "SELECT request_id, min(s.store_code) AS store_code, count(*) > 1 AS need_confirm, count(*) AS n_candidates FROM store_requests r JOIN stores s ON s.store_name = r.store_name GROUP BY request_id", STO)
def _(t):
    return st.by_exact_name(t.store_requests, t.stores).select("request_id", "store_code", "need_confirm", "n_candidates")


@query("j08_contained_store_name", """SELECT request_id, store_code FROM (SELECT DISTINCT store_name FROM store_requests WHERE store_name <> '') n JOIN stores s ON contains(s.store_name, n.store_name) JOIN store_requests r ON r.store_name = n.store_name
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY length(s.store_name), s.store_name, store_code) = 1""", STO)
def _(t):
    return st.by_contained_name(t.store_requests, t.stores).select("request_id", "store_code")


@query("j09_company_join", """WITH o AS (SELECT DISTINCT r.company, w.customer_name, w.customer_id FROM store_requests r JOIN owners w ON contains(w.customer_name, r.company) WHERE w.status = 'ACTIVE' AND r.company <> ''),
  f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY company ORDER BY customer_name, customer_id) = 1), h AS (SELECT owner_code, min(store_code) AS store_code FROM stores GROUP BY owner_code)
  SELECT request_id, h.store_code FROM store_requests r JOIN f ON f.company = r.company JOIN h ON h.owner_code = f.customer_id""", ("store_requests", "stores", "owners"))
def _(t):
    return st.by_company(t.store_requests, t.stores, t.owners).select("request_id", "store_code")


ADDRESS_HITS = """wd AS (SELECT address, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT DISTINCT address, regexp_extract_all(address, '[A-Z]{2,}') AS w FROM store_requests WHERE address <> '') x),
 ok AS (SELECT address, word FROM wd WHERE EXISTS (SELECT 1 FROM stores s WHERE contains(s.store_name, wd.word)) QUALIFY row_number() OVER (PARTITION BY address ORDER BY length(word) DESC, pos) = 1),
 hs AS (SELECT o.address, o.word, s.address AS store_address, min(s.store_code) AS store_code FROM ok o JOIN stores s ON contains(s.store_name, o.word) GROUP BY ALL),
 same AS (SELECT address, min(store_code) AS store_code FROM hs WHERE address = store_address GROUP BY address)"""


@query("j10_address_join", f"WITH {ADDRESS_HITS} SELECT request_id, s.store_code FROM store_requests r JOIN same s ON s.address = r.address", STO)
def _(t):
    # every requested address is the address of a store, so the closest address is an equal one
    return st.by_address(t.store_requests, t.stores, char_class=LETTERS).select("request_id", "store_code")


@query("j11_contact_phone", ratio_cte("SELECT DISTINCT a, b FROM pp", """ask AS (SELECT * FROM store_requests WHERE length(contact_person) >= 2 AND contact_person <> store_name AND phone <> '')""",
    "pp AS (SELECT r.request_id, r.store_name AS a, s.store_name AS b, s.store_code, count(*) OVER (PARTITION BY r.request_id) AS n_phone FROM ask r JOIN stores s ON s.phone = r.phone)") + """,
  be AS (SELECT request_id, store_code, n_phone, ratio, count(CASE WHEN ratio >= 0.5 THEN 1 END) OVER (PARTITION BY request_id) AS n FROM pp JOIN ratios r ON r.a = pp.a AND r.b = pp.b QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ratio DESC, store_code) = 1)
  SELECT request_id, store_code, CASE WHEN n_phone = 1 THEN 'phone_exact' WHEN ratio >= 0.8 THEN 'phone_exact_high_conf' ELSE 'phone_exact_multi' END AS match_type, round(CASE WHEN n_phone = 1 THEN 1.0e0 ELSE ratio END, 6) AS similarity,
    n_phone > 1 AND ratio < 0.8 AS need_confirm, CASE WHEN n_phone = 1 OR ratio >= 0.8 THEN 1 ELSE n END AS n_candidates FROM be""", STO)
def _(t):
    return st.by_contact_phone(t.store_requests, t.stores).withColumn("similarity", F.round("similarity", 6))


# names of many kinds: the first words of each document, for requests with a letter left out or words turned
NAMED = r"""SELECT doc_id, array_to_string(string_split(regexp_replace(text, '[\t\n\v\f\r ]+', ' ', 'g'), ' ')[1:3], ' ') AS name FROM documents"""
ASKED = "SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN concat(substring(name, 1, 4), substring(name, 6)) WHEN 1 THEN concat(name, ' x') ELSE concat(substring(name, 5), ' ', substring(name, 1, 3)) END AS store_name FROM named"


def named(t):
    first = F.regexp_extract("text", r"^[^\t\n\v\f\r ]*(?:[\t\n\v\f\r ]+[^\t\n\v\f\r ]*){0,2}", 0)  # the rest of the text is not read
    return t.documents.select("doc_id", F.regexp_replace(first, r"[\t\n\v\f\r ]+", " ").alias("name"))


def asked(t):
    name, k = F.col("name"), F.col("doc_id") % 3
    return named(t).select(F.col("doc_id").alias("request_id"), F.when(k == 0, F.concat(F.substr(name, F.lit(1), F.lit(4)), F.substr(name, F.lit(6)))).when(
        k == 1, F.concat(name, F.lit(" x"))).otherwise(F.concat(F.substr(name, F.lit(5)), F.lit(" "), F.substr(name, F.lit(1), F.lit(3)))).alias("store_name"))


# blocks found alike are a common subsequence, so a ratio of r allows (1 - r) of both lengths as edits: that bounds what the
# twin scores (every character becomes one byte first, which brings no two texts further apart)
PLAIN = "regexp_replace(strip_accents({}), '[^ -~]', '?', 'g')"


def _like(floor):
    return ratio_cte("SELECT DISTINCT a, b FROM near", f"named AS ({NAMED})", f"ask AS ({ASKED})",
                     f"near AS (SELECT a.store_name AS a, n.name AS b FROM (SELECT DISTINCT store_name FROM ask WHERE store_name <> '') a, (SELECT DISTINCT name FROM named WHERE name <> '') n WHERE levenshtein({PLAIN.format('a.store_name')}, {PLAIN.format('n.name')}) <= {1 - floor} * (length(a.store_name) + length(n.name)) + 1e-9)")


@query("j08_similar_candidates", _like(0.75) + """ SELECT request_id, concat('ST', cast(doc_id AS varchar)) AS store_code, round(ratio, 6) AS score FROM ratios r JOIN ask ON ask.store_name = r.a JOIN named ON named.name = r.b WHERE ratio >= 0.75""")
def _(t):
    stores = named(t).select(F.concat(F.lit("ST"), F.col("doc_id").cast("string")).alias("store_code"), F.col("name").alias("store_name"))
    return st.similar_candidates(asked(t), stores, 0.75).select("request_id", "store_code", F.round("score", 6).alias("score"))


@query("j08_similar_store_name", _like(0.75) + """, c AS (SELECT request_id, concat('ST', cast(doc_id AS varchar)) AS store_code, ratio FROM ratios r JOIN ask ON ask.store_name = r.a JOIN named ON named.name = r.b WHERE ratio >= 0.75),
  b AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM c QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ratio DESC, store_code) = 1)
  SELECT request_id, store_code, CASE WHEN ratio >= 0.9 THEN 'fuzzy_similar' ELSE 'fuzzy' END AS match_type, round(ratio, 6) AS similarity, ratio < 0.9 AS need_confirm, CASE WHEN ratio >= 0.9 THEN 1 ELSE n END AS n_candidates FROM b""")
def _(t):
    stores = named(t).select(F.concat(F.lit("ST"), F.col("doc_id").cast("string")).alias("store_code"), F.col("name").alias("store_name"))
    return st.similar_names(asked(t), stores, 0.9, 0.75).withColumn("similarity", F.round("similarity", 6))


@query("j15_similar_owners", _like(0.7) + """ SELECT request_id, concat('O', cast(doc_id AS varchar)) AS customer_id, name AS customer_name, round(ratio, 6) AS similarity FROM ratios r JOIN ask ON ask.store_name = r.a JOIN named ON named.name = r.b WHERE ratio >= 0.7 AND doc_id % 5 <> 0""")
def _(t):
    owners = named(t).select(F.concat(F.lit("O"), F.col("doc_id").cast("string")).alias("customer_id"), F.col("name").alias("customer_name"), F.when(F.col("doc_id") % 5 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"))
    return st.similar_owners(asked(t), owners).withColumn("similarity", F.round("similarity", 6))


@query("j11_contact_join", """SELECT request_id, store_code, round(2.0 * length(contact_person) / (length(contact_person) + length(store)), 6) AS similarity FROM (SELECT r.request_id, r.contact_person, s.store_name AS store, s.store_code FROM store_requests r JOIN stores s ON contains(s.store_name, r.contact_person)
  WHERE r.contact_person <> '' AND 2.0 * length(r.contact_person) / (length(r.contact_person) + length(s.store_name)) >= 0.5) x QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY length(store), store_code) = 1""", STO)
def _(t):
    return st.by_contact(t.store_requests, t.stores, 0.5).select("request_id", "store_code", F.round("similarity", 6).alias("similarity"))


@query("j12_cross_words", """SELECT DISTINCT store_name, word FROM (SELECT store_name, unnest(regexp_extract_all(replace(store_name, 'BUILDING', ''), '[A-Z]{2,4}')[1:3]) AS word FROM store_requests) x""", REQ)
def _(t):
    return st.cross_keywords(t.store_requests, ["BUILDING"], char_class=LETTERS)


@query("j12_cross_keyword_join")
def _(t):
    return st.by_cross_keywords(t.store_requests, t.stores, char_class="0-9")


@query("j13_brand_and_warehouse", """WITH n AS (SELECT DISTINCT concat(brand, lpad(cast(c_nationkey AS varchar), 4, 'N'), '仓') AS store_name, concat(lpad(cast(c_nationkey AS varchar), 4, 'N'), '仓') AS warehouse, brand
    FROM (SELECT c_nationkey, concat('Supplier#0000', lpad(cast(c_custkey % 100 AS varchar), 5, '0')) AS brand FROM customer) x),
  h AS (SELECT concat(lpad(replace(warehouse, 'NATION_', ''), 4, 'N'), '仓') AS warehouse, owner_code, min(store_code) AS store_code FROM stores GROUP BY ALL), b AS (SELECT n.store_name, min(o.customer_id) AS owner_code FROM n JOIN owners o ON contains(o.customer_name, n.brand) AND o.status = 'ACTIVE' GROUP BY ALL),
  t AS (SELECT h.warehouse, min(h.owner_code) AS other FROM h WHERE h.owner_code IN (SELECT customer_id FROM owners WHERE status = 'ACTIVE') GROUP BY ALL)
  SELECT n.store_name, h.store_code FROM n LEFT JOIN b USING (store_name) LEFT JOIN t USING (warehouse) JOIN h ON h.warehouse = n.warehouse AND h.owner_code = coalesce(b.owner_code, t.other)""", ("stores", "owners"))
def _(t):
    house = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 4, "N"), F.lit("仓"))
    names = t.customer.select(F.concat(F.lit("Supplier#0000"), F.lpad((F.col("c_custkey") % 100).cast("string"), 5, "0"), house).alias("store_name")).distinct()
    stores = t.stores.withColumn("warehouse", F.concat(F.lpad(F.replace("warehouse", F.lit("NATION_"), F.lit("")), 4, "N"), F.lit("仓")))
    hits = st.by_brand_and_warehouse(names.withColumn("request_id", F.col("store_name")), stores, t.owners)
    return hits.select(F.col("request_id").alias("store_name"), "store_code")


@query("j14_warehouse_codes", "SELECT store_code, warehouse, coalesce(warehouse_code, '') AS warehouse_code FROM stores LEFT JOIN warehouses ON warehouse_name = warehouse", ("stores", "warehouses"))
def _(t):
    return st.add_warehouse_code(t.stores, t.warehouses).select("store_code", "warehouse", "warehouse_code")


@query("j14_missing_codes", "SELECT store_code, warehouse FROM stores WHERE warehouse NOT IN (SELECT warehouse_name FROM warehouses WHERE warehouse_code <> '')", ("stores", "warehouses"))
def _(t):
    return st.missing_warehouse_codes(t.stores, t.warehouses).select("store_code", "warehouse")


@query("j15_owner_hints", """SELECT request_id, customer_id, customer_name FROM (SELECT DISTINCT r.company AS text, o.customer_id, o.customer_name FROM store_requests r JOIN owners o ON contains(o.customer_name, r.company) WHERE r.company <> '' AND o.status = 'ACTIVE'
  QUALIFY dense_rank() OVER (PARTITION BY r.company ORDER BY o.customer_name, o.customer_id) <= 10) h JOIN store_requests r ON r.company = h.text""", ("store_requests", "owners"))
def _(t):
    asked = t.store_requests.select("request_id", F.col("company").alias("store_name"))
    return st.owner_hints(asked, t.owners, 10)


@query("j16_owner_of_name", """WITH n AS (SELECT DISTINCT store_name AS name FROM store_requests), o AS (SELECT store_name, min(owner_code) AS owner_code FROM stores GROUP BY ALL),
  c AS (SELECT n.name, o.owner_code FROM n JOIN o ON contains(o.store_name, n.name) OR contains(n.name, o.store_name) WHERE NOT EXISTS (SELECT 1 FROM o e WHERE e.store_name = n.name)
    QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY abs(length(o.store_name) - length(n.name)), o.store_name) = 1)
  SELECT n.name, coalesce(e.owner_code, c.owner_code, '') AS owner_code, CASE WHEN e.owner_code IS NOT NULL THEN 'exact' WHEN c.owner_code IS NOT NULL THEN 'contains' ELSE 'unresolved' END AS source FROM n LEFT JOIN o e ON e.store_name = n.name LEFT JOIN c ON c.name = n.name""", STO)
def _(t):
    return st.owner_of_name(t.store_requests.select(F.col("store_name").alias("name")), t.stores)


@query("j17_lines_to_stores", "SELECT order_id, line_no, true_sku, concat('K', cast(order_id AS varchar)) AS store_key FROM order_lines WHERE line_no % 3 <> 2", ("order_lines",))
def _(t):
    key = F.concat(F.lit("K"), F.col("order_id").cast("string"))
    name = F.concat(F.lit("N"), F.col("order_id").cast("string"))
    m = F.col("line_no") % 3
    lines = t.order_lines.select("order_id", "line_no", "true_sku", F.when(m == 0, key).when(m == 1, name).otherwise("other").alias("line_store"))
    stores = t.order_lines.select("order_id").distinct().select("order_id", key.alias("store_key"), name.alias("store_name"))
    return st.lines_to_stores(lines, stores).select("order_id", "line_no", "true_sku", "store_key")


def confirmed(t):
    k = F.col("o_orderkey")
    text = k.cast("string")
    matches = t.orders.select(k.alias("order_id"), F.concat(F.lit("K"), text).alias("store_key"), F.concat(F.lit("N"), text).alias("store_name"), F.concat(F.lit("ST"), text).alias("store_code"))
    rows = t.orders.where("o_orderkey % 5 < 4").select(
        k.alias("order_id"), F.when(k % 5 == 0, F.concat(F.lit("K"), text)).when(k % 5 == 1, F.concat(F.lit("N"), text)).when(k % 5 == 2, F.lit("x")).otherwise("other store").alias("confirm_key"),
        F.when(k % 5 == 2, F.concat(F.lit("N"), text)).otherwise("").alias("submitted_name"), F.when(k % 2 == 0, F.concat(F.lit("ST"), text)).otherwise(F.concat(F.lit("UC"), text)).alias("confirmed_code"), F.lit(1).alias("seq"))
    return st.with_confirmations(matches, rows)


@query("j18_prior_confirmations", "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 5 < 3 THEN concat(CASE WHEN o_orderkey % 2 = 0 THEN 'ST' ELSE 'UC' END, cast(o_orderkey AS varchar)) ELSE concat('ST', cast(o_orderkey AS varchar)) END AS final_code FROM orders")
def _(t):
    return confirmed(t).select("order_id", "final_code")


@query("j19_store_corrections", "SELECT o_orderkey AS order_id, concat('ST', cast(o_orderkey AS varchar)) AS store_code, concat('UC', cast(o_orderkey AS varchar)) AS confirmed_code FROM orders WHERE o_orderkey % 5 < 3 AND o_orderkey % 2 = 1")
def _(t):
    return st.store_corrections(confirmed(t)).select("order_id", "store_code", "confirmed_code")


@query("n02_merge_confirmations", "SELECT user_id AS order_id, concat('S', cast(event_id % 7 AS varchar)) AS confirm_key, arg_max(concat('ST', cast(event_id AS varchar)), event_id) AS confirmed_code FROM events WHERE event_type = 'click' GROUP BY ALL")
def _(t):
    kind, key, code = F.col("event_id") % 5, F.concat(F.lit("S"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("ST"), F.col("event_id").cast("string"))
    named = [F.when(kind == i + 1, key).alias(name) for i, name in enumerate(fv.CONFIRMATION_KEYS)]
    answers = t.events.where("event_type = 'click'").select(
        F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), F.when(kind == 0, F.create_map(key, code)).alias("confirmed_stores"),
        F.when(kind != 0, code).alias("store_code"), *named)
    return st.merge_confirmations(answers)


@query("q07_auto_confirmed", """SELECT request_id, CASE WHEN n = 1 THEN 'auto_confirmed' WHEN n > 1 THEN 'pending' ELSE 'failed' END AS status FROM (SELECT request_id, (SELECT count(*) FROM stores s WHERE s.store_name = r.store_name) AS n FROM store_requests r) x""", STO)
def _(t):
    hits = st.by_exact_name(t.store_requests, t.stores)
    j = t.store_requests.select("request_id").join(hits, "request_id", "left")
    auto = st.auto_confirmed(F.col("match_type"), F.col("need_confirm"), F.col("n_candidates"))
    return j.select("request_id", F.when(auto, "auto_confirmed").when(F.col("store_code").isNotNull(), "pending").otherwise("failed").alias("status"))


@query("m04_order_state", """WITH s AS (SELECT order_id % 500 AS order_id, CASE WHEN order_id % 7 = 0 THEN 'pending' WHEN order_id % 11 = 0 THEN 'need_hint' WHEN order_id % 13 = 0 THEN 'failed' ELSE 'confirmed' END AS status FROM order_metrics),
  p AS (SELECT order_id, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'need_hint' THEN 1 END) AS hints, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM s GROUP BY ALL), u AS (SELECT order_id, count(*) AS n FROM order_lines WHERE flag = 'R' GROUP BY ALL)
  SELECT p.order_id, pending, hints, failed, coalesce(n, 0) AS n_unmatched, CASE WHEN pending > 0 THEN 'needs_store_confirm' WHEN hints > 0 THEN 'needs_hint' WHEN failed > 0 THEN 'failed' WHEN coalesce(n, 0) > 0 THEN 'needs_sku_confirm' ELSE 'success' END AS state FROM p LEFT JOIN u ON u.order_id = p.order_id""", ("order_metrics", "order_lines"))
def _(t):
    k = F.col("order_id")
    status = t.order_metrics.select((k % 500).alias("order_id"), F.when(k % 7 == 0, "pending").when(k % 11 == 0, "need_hint").when(k % 13 == 0, "failed").otherwise("confirmed").alias("status"))
    open_lines = t.order_lines.where("flag = 'R'").groupBy("order_id").agg(F.count(F.lit(1)).alias("n_unmatched"))
    return st.order_state(status, open_lines)


@query("j21_store_truth", """SELECT r.request_id, coalesce(h.store_code = r.true_store, false) AS store_hit, coalesce(hs.owner_code = ts.owner_code, false) AS owner_hit, coalesce(tw.warehouse_code, '') <> '' AS has_warehouse,
  coalesce(coalesce(tw.warehouse_code, '') <> '' AND hw.warehouse_code = tw.warehouse_code, false) AS warehouse_hit FROM store_requests r LEFT JOIN (SELECT request_id, min(s.store_code) AS store_code FROM store_requests q JOIN stores s ON s.store_name = q.store_name GROUP BY ALL) h ON h.request_id = r.request_id
  LEFT JOIN stores ts ON ts.store_code = r.true_store LEFT JOIN stores hs ON hs.store_code = h.store_code LEFT JOIN warehouses tw ON tw.warehouse_name = ts.warehouse LEFT JOIN warehouses hw ON hw.warehouse_name = hs.warehouse""", ("store_requests", "stores", "warehouses"))
def _(t):
    return ev.store_truth(st.by_exact_name(t.store_requests, t.stores), t.store_requests.select("request_id", "true_store"), t.stores, t.warehouses)


@query("a24_stores_per_warehouse", "SELECT warehouse_name, count(store_code) AS n_stores FROM warehouses LEFT JOIN stores ON warehouse = warehouse_name GROUP BY warehouse_name ORDER BY n_stores DESC, warehouse_name LIMIT 10", ("warehouses", "stores"))
def _(t):
    joined = t.warehouses.join(t.stores, F.col("warehouse") == F.col("warehouse_name"), "left")
    return joined.groupBy("warehouse_name").agg(F.count("store_code").alias("n_stores")).orderBy(F.col("n_stores").desc(), "warehouse_name").limit(10)


@query("w07_first_store_of_owner", "SELECT owner_code, store_code, store_name, warehouse FROM stores QUALIFY row_number() OVER (PARTITION BY owner_code ORDER BY store_name, store_code) = 1", ("stores",))
def _(t):
    from ..operators.ranking import first_per_key

    return first_per_key(t.stores, ["owner_code"], [F.col("store_name"), F.col("store_code")]).select("owner_code", "store_code", "store_name", "warehouse")


@query("w09_top_stores_of_owner", "SELECT owner_code, store_code, row_number() OVER (PARTITION BY owner_code ORDER BY length(store_name) DESC, store_code) AS rank FROM stores QUALIFY rank <= 5", ("stores",))
def _(t):
    from ..operators.ranking import top_k

    return top_k(t.stores, ["owner_code"], [F.length("store_name").desc(), F.col("store_code")], 5).select("owner_code", "store_code", "rank")


@query("w01_store_cascade")
def _(t):
    return st.match_stores(t.store_requests, t.stores, t.owners, char_class=LETTERS, cross_class="0-9").select("request_id", "store_code", "match_type", F.round("similarity", 6).alias("similarity"), "need_confirm", "n_candidates")
