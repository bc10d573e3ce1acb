"""Scalar functions over the names, texts and codes of the given tables."""

from pyspark.sql import functions as F

from ..functions import parsing as ps
from ..functions import similarity as sim
from ..functions import text as tx
from . import query

SCRUB = r"""replace(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\t\x{{a0}}\x{{3000}}\x{{200b}}-\x{{200f}}\x{{feff}}]+', '', 'g'), ' ', '')"""
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[（(][^)）]*[)）]', '', 'g'), '[\s\p{{Z}}]+', '', 'g'), '[-_./\\,;:]+$', ''), '^[-_./\\,;:]+', '')"""
SPEC = r"""coalesce(nullif(regexp_extract({0}, '(?i)\d+KG\s*[*×]\s*\d+[包袋箱件个条]'), ''), nullif(regexp_extract({0}, '(?i)\d+[包袋箱件个条]\s*[*×]\s*\d+KG'), ''),
 nullif(regexp_extract({0}, '\d+[包袋箱件个条]/\d+[包袋箱件个条]'), ''), nullif(regexp_extract({0}, '\d+[包袋箱件个条]\s*[*×]\s*\d+[包袋箱件个条]'), ''),
 CASE WHEN regexp_matches(regexp_extract({0}, '[（(]([^）)]+)[）)]', 1), '\d') AND regexp_matches(regexp_extract({0}, '[（(]([^）)]+)[）)]', 1), '[包袋箱件个条]') THEN regexp_extract({0}, '[（(]([^）)]+)[）)]', 1) END, '')"""
GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - {1} + 2, 1)), lambda i: substring({0}, i, {1})))"


def names(t):
    return t.order_lines.select("product_name").distinct()


@query("p01_scrub", f"SELECT DISTINCT product_name, {SCRUB.format('product_name')} AS scrubbed FROM order_lines", ("order_lines",))
def _(t):
    return names(t).select("product_name", tx.scrub("product_name").alias("scrubbed"))


@query("p02_clean_name", f"SELECT DISTINCT product_name, {CLEAN.format('product_name')} AS cleaned FROM order_lines", ("order_lines",))
def _(t):
    return names(t).select("product_name", tx.clean_name("product_name").alias("cleaned"))


@query("p03_clean_name_hard", r"""SELECT DISTINCT product_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(product_name,
  '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '-+$', ''), '/+$', ''), '\.+$', ''), '[（(].*[)）]', '', 'g'), '[^\p{L}\p{N}_/]', '', 'g') AS cleaned FROM order_lines""", ("order_lines",))
def _(t):
    return names(t).select("product_name", tx.clean_name_hard("product_name").alias("cleaned"))


@query("p04_spec_of_name", f"SELECT DISTINCT product_name, {SPEC.format('product_name')} AS spec FROM order_lines", ("order_lines",))
def _(t):
    return names(t).select("product_name", tx.spec_of("product_name").alias("spec"))


RATIO = """WITH RECURSIVE ratio_pairs AS ({pairs}),
blocks AS (
  SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size FROM ratio_pairs
  UNION ALL
  SELECT w.a, w.b, s.alo, s.ahi, s.blo, s.bhi, s.size FROM (
    SELECT p.a, p.b, p.alo, p.ahi, p.blo, p.bhi, m.best.i AS i, m.best.j AS j, m.best.k AS k
    FROM blocks p, LATERAL (
      SELECT max_by({{'i': i, 'j': j, 'k': k}}, k * 1000000 - i * 1000 - j) AS best FROM (
        SELECT x.i, y.j, z.k FROM (SELECT unnest(range(p.alo, p.ahi)) AS i) x, (SELECT unnest(range(p.blo, p.bhi)) AS j) y,
          LATERAL (SELECT max(k) AS k FROM (SELECT unnest(range(1, least(p.ahi - x.i, p.bhi - y.j) + 1)) AS k) n
            WHERE substring(p.a, x.i, n.k) = substring(p.b, y.j, n.k)) z
        WHERE substring(p.a, x.i, 1) = substring(p.b, y.j, 1))) m
    WHERE p.size = 0 AND p.alo < p.ahi AND p.blo < p.bhi AND m.best IS NOT NULL) w,
    LATERAL (SELECT unnest([{{'alo': w.alo, 'ahi': w.i, 'blo': w.blo, 'bhi': w.j, 'size': 0}}, {{'alo': w.i + w.k, 'ahi': w.ahi, 'blo': w.j + w.k, 'bhi': w.bhi, 'size': 0}},
      {{'alo': w.i, 'ahi': w.i, 'blo': w.j, 'bhi': w.j, 'size': w.k}}], recursive := true)) s),
ratios AS (SELECT a, b, 2.0e0 * sum(size) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b)
"""
SPEC_PAIRS = """SELECT DISTINCT concat(cast(p_size AS varchar), '包*', cast(1 + p_partkey % 4 AS varchar), 'KG') AS a,
  concat(cast(1 + p_size % 7 AS varchar), '包/', cast(1 + p_partkey % 3 AS varchar), '箱') AS b FROM part"""


@query("p05_spec_score", RATIO.format(pairs=SPEC_PAIRS) + r""",
p AS (SELECT a, b, ratio, regexp_extract_all(a, '\d+') AS an, regexp_extract_all(b, '\d+') AS bn, regexp_extract_all(a, '[包袋箱件个条]') AS au, regexp_extract_all(b, '[包袋箱件个条]') AS bu FROM ratios)
SELECT a, b, round(CASE WHEN a = b THEN 1.0 WHEN an = bn AND au = bu THEN 1.0 WHEN au[1] <> bu[1] THEN 0.3 WHEN list_sort(list_distinct(an)) = list_sort(list_distinct(bn)) THEN 0.8 ELSE ratio END, 6) AS score FROM (
  SELECT lower(a) AS a, lower(b) AS b, (SELECT ratio) AS ratio, an, bn, au, bu FROM p)""")
def _(t):
    pairs = t.part.select(
        F.concat(F.col("p_size").cast("string"), F.lit("包*"), (1 + F.col("p_partkey") % 4).cast("string"), F.lit("KG")).alias("a"),
        F.concat((1 + F.col("p_size") % 7).cast("string"), F.lit("包/"), (1 + F.col("p_partkey") % 3).cast("string"), F.lit("箱")).alias("b")).distinct()
    needs = tx.spec_needs_ratio(F.col("a"), F.col("b"))
    ratio = sim.seq_ratio(F.when(needs, F.lower("a")), F.when(needs, F.lower("b")))
    return pairs.select(F.lower("a").alias("a"), F.lower("b").alias("b"), F.round(tx.spec_score(F.col("a"), F.col("b"), ratio), 6).alias("score"))


CLEAN_PAIRS = f"SELECT DISTINCT {CLEAN.format('product_name')} AS a, true_name AS b FROM (SELECT product_name, sku_name AS true_name FROM order_lines JOIN catalog ON true_sku = sku_code)"


def clean_pairs(t):
    pairs = t.order_lines.select("product_name", F.col("true_sku").alias("sku_code")).distinct().join(t.catalog.select("sku_code", "sku_name"), "sku_code")
    return pairs.select(tx.clean_name("product_name").alias("a"), F.col("sku_name").alias("b")).distinct()


@query("p06_containment_boost", f"SELECT a, b, CASE WHEN contains(b, a) THEN 0.25e0 WHEN contains(a, b) THEN 0.1e0 ELSE 0.0e0 END AS boost FROM ({CLEAN_PAIRS}) x", ("order_lines", "catalog"))
def _(t):
    return clean_pairs(t).withColumn("boost", tx.containment_boost(F.col("a"), F.col("b")))


@query("p07_core_word_gate", f"""SELECT a, b, CASE WHEN contains(b, a) OR contains(a, b) OR ca = '' OR cb = '' THEN true WHEN contains(cb, ca) OR contains(ca, cb) THEN true
  WHEN contains(ca, 'econ') OR contains(cb, 'econ') THEN ca = cb
  ELSE (contains(ca, 'bolt') AND contains(cb, 'bolt')) OR (contains(ca, 'gear') AND contains(cb, 'gear')) OR (contains(ca, 'ring') AND contains(cb, 'ring')) END AS passes
  FROM (SELECT a, b, regexp_replace(a, '^[0-9]+[a-zA-Z]*', '') AS ca, regexp_replace(b, '^[0-9]+[a-zA-Z]*', '') AS cb FROM ({CLEAN_PAIRS}) x) y""", ("order_lines", "catalog"))
def _(t):
    return clean_pairs(t).withColumn("passes", tx.core_word_gate(F.col("a"), F.col("b"), ["bolt", "gear", "ring"], ["econ"]))


NAME_PAIRS = "SELECT DISTINCT n.n_name AS a, concat(r_name, '_', cast(n.n_nationkey % 7 AS varchar)) AS b FROM nation n JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT p_name, concat(lower(p_type), ' ', substring(p_name, 2)) FROM part"


@query("p08_sequence_ratio", RATIO.format(pairs=NAME_PAIRS) + "SELECT a, b, round(ratio, 6) AS ratio FROM ratios")
def _(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("a"), F.concat("r_name", F.lit("_"), (F.col("n_nationkey") % 7).cast("string")).alias("b"))
    p = t.part.select(F.col("p_name").alias("a"), F.concat(F.lower("p_type"), F.lit(" "), F.substr("p_name", F.lit(2))).alias("b"))
    return n.union(p).distinct().select("a", "b", F.round(sim.seq_ratio("a", "b"), 6).alias("ratio"))


@query("p09_store_similarity", r"""SELECT a, b, round(CASE WHEN contains(x, y) OR contains(y, x) THEN greatest(r, least(length(x), length(y)) / greatest(length(x), length(y)) + 0.3) ELSE r END, 6) AS similarity FROM (
  SELECT a, b, x, y, 2.0 * least(length(x), length(y)) / (length(x) + length(y)) AS r FROM (
    SELECT store_name AS a, substring(store_name, 1, length(store_name) - 3) AS b, CASE WHEN store_name LIKE 'BUILDING-%' THEN substring(store_name, 10) ELSE store_name END AS x,
      CASE WHEN store_name LIKE 'BUILDING-%' THEN substring(substring(store_name, 1, length(store_name) - 3), 10) ELSE substring(store_name, 1, length(store_name) - 3) END AS y FROM stores) p) q""", ("stores",))
def _(t):
    brands = ["BUILDING-"]
    pairs = t.stores.select(F.col("store_name").alias("a")).withColumn("b", F.left("a", F.length("a") - 3))
    x, y = tx.strip_first_prefix("a", brands), tx.strip_first_prefix("b", brands)
    ratio = sim.plain_ratio(x, y)
    return pairs.select("a", "b", F.round(sim.store_similarity(F.col("a"), F.col("b"), ratio, brands), 6).alias("similarity"))


G23 = "list_filter(list_concat(" + GRAMS.format("{0}", 2) + ", " + GRAMS.format("{0}", 3) + "), lambda g: regexp_full_match(g, '[a-z]+'))"


@query("p10_gram_gate_and_boost", f"""SELECT a, b, CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN true ELSE len(list_intersect(ga, gb)) > 0 END AS passes,
  round(least(len(list_intersect(ga, gb)) * 0.1e0, 0.3e0), 6) AS boost FROM (SELECT a, b, {G23.format('a')} AS ga, {G23.format('b')} AS gb FROM ({CLEAN_PAIRS}) x) y""", ("order_lines", "catalog"))
def _(t):
    return clean_pairs(t).select("a", "b", tx.gram_gate(F.col("a"), F.col("b"), "a-z").alias("passes"), F.round(tx.gram_boost(F.col("a"), F.col("b"), "a-z"), 6).alias("boost"))


LETTERS = "regexp_replace({0}, '[^a-z]', '', 'g')"


@query("p11_bigram_coverage", f"""SELECT a, b, round(CASE WHEN len(ga) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / len(ga) END, 6) AS coverage FROM (
  SELECT a, b, {GRAMS.format('la', 2)} AS ga, {GRAMS.format('lb', 2)} AS gb FROM (SELECT a, b, {LETTERS.format('a')} AS la, {LETTERS.format('b')} AS lb FROM ({CLEAN_PAIRS}) x) y) z""", ("order_lines", "catalog"))
def _(t):
    return clean_pairs(t).withColumn("coverage", F.round(tx.bigram_coverage(F.col("a"), F.col("b"), "a-z"), 6))


@query("p12_strip_first_prefix", r"""SELECT store_name, CASE WHEN store_name LIKE 'BUILDING-%' THEN regexp_replace(substring(store_name, 10), '^-+', '')
  WHEN store_name LIKE 'MACHINERY%' THEN regexp_replace(substring(store_name, 10), '^-+', '') ELSE store_name END AS bare FROM stores""", ("stores",))
def _(t):
    return t.stores.select("store_name", tx.strip_first_prefix("store_name", ["BUILDING-", "MACHINERY"], trim_dash=True).alias("bare"))


@query("p13_keywords", r"""SELECT doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:5], ',') AS words FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{2,4}') AS k FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.keywords("text", 5, "a-z"), ",").alias("words"))


@query("p14_edge_keywords", r"""SELECT DISTINCT p_name, array_to_string(list_filter([CASE WHEN n >= 5 THEN left(p_name, 5) END, CASE WHEN n > 5 THEN right(p_name, 5) END, CASE WHEN n >= 4 THEN left(p_name, 4) END, CASE WHEN n > 4 THEN right(p_name, 4) END,
  CASE WHEN n >= 3 THEN left(p_name, 3) END, CASE WHEN n > 3 THEN right(p_name, 3) END, CASE WHEN n >= 2 THEN left(p_name, 2) END, CASE WHEN n > 2 THEN right(p_name, 2) END], lambda x: x IS NOT NULL), '|') AS words
  FROM (SELECT left(p_name, 1 + p_partkey % 9) AS p_name, length(left(p_name, 1 + p_partkey % 9)) AS n FROM part)""")
def _(t):
    return t.part.select(F.left("p_name", (1 + F.col("p_partkey") % 9).cast("int")).alias("p_name")).distinct().select("p_name", F.array_join(tx.edge_keywords("p_name"), "|").alias("words"))


ADDRESS = "concat(CASE c_custkey % 4 WHEN 0 THEN '江苏省' WHEN 1 THEN '徐州市' ELSE '' END, ' ', CASE c_custkey % 3 WHEN 0 THEN '沛县' WHEN 1 THEN '城南区' ELSE '' END, ' 大路', cast(c_custkey AS varchar(20)), '号楼')"


@query("p15_address_keywords", f"""SELECT address, array_to_string(CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '县|区'))) > 0 THEN list_filter(w, lambda x: regexp_matches(x, '县|区'))[1:1]
  WHEN len(list_filter(w, lambda x: contains(x, '市'))) > 0 THEN list_filter(w, lambda x: contains(x, '市'))[1:1] WHEN len(list_filter(w, lambda x: contains(x, '省'))) > 0 THEN list_filter(w, lambda x: contains(x, '省'))[1:1] ELSE w[1:2] END, ',') AS words
  FROM (SELECT address, regexp_extract_all(address, '[一-龥]{{2,4}}') AS w FROM (SELECT {ADDRESS} AS address FROM customer))""")
def _(t):
    return t.customer.select(F.expr(ADDRESS.replace("varchar(20)", "string")).alias("address")).select("address", F.array_join(tx.address_keywords("address"), ",").alias("words"))


@query("p16_invalid_store_name", "SELECT request_id, store_name, length(store_name) < 3 OR starts_with(store_name, '店铺') OR starts_with(store_name, '门店') OR starts_with(store_name, 'SN') OR starts_with(store_name, 'PN') AS invalid FROM store_requests", ("store_requests",))
def _(t):
    return t.store_requests.select("request_id", "store_name", tx.invalid_store_name("store_name").alias("invalid"))


@query("p17_numbers", r"""SELECT event_id, cast(coalesce(floor(try_cast(nullif(regexp_replace(props, '[^0-9.]', '', 'g'), '') AS double)), 0) AS bigint) AS safe, cast(coalesce(floor(try_cast(nullif(regexp_extract(concat('数量：', cast(value AS varchar)), '\d+(?:\.\d+)?'), '') AS double)), 0) AS bigint) AS first FROM events""")
def _(t):
    return t.events.select("event_id", tx.safe_int("props").alias("safe"), tx.first_number(F.concat(F.lit("数量："), F.col("value").cast("string"))).alias("first"))


@query("p18_first_non_empty", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'none') AS value FROM orders")
def _(t):
    k = F.col("o_orderkey")
    first = F.when(k % 3 == 0, "").when(k % 3 == 1, "nan").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", tx.first_non_empty(first, F.when(k % 2 == 0, F.col("o_orderstatus")), default="none").alias("value"))


FILE_NAME = "concat('file', cast(p_partkey AS varchar(20)), CASE p_partkey % 8 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLS' WHEN 2 THEN '.jpg' WHEN 3 THEN '.webp' WHEN 4 THEN '.pdf' WHEN 5 THEN '.docx' WHEN 6 THEN '.txt' ELSE '' END)"


@query("p19_input_kind", f"""SELECT f, CASE WHEN regexp_matches(lower(f), '\\.(xlsx|xls)$') THEN 'excel' WHEN regexp_matches(lower(f), '\\.(jpg|jpeg|png|bmp|gif|webp)$') THEN 'image'
  WHEN regexp_matches(lower(f), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(f), '\\.(docx|doc)$') THEN 'word' ELSE 'text' END AS kind FROM (SELECT {FILE_NAME} AS f FROM part)""")
def _(t):
    return t.part.select(F.expr(FILE_NAME.replace("varchar(20)", "string")).alias("f")).select("f", tx.input_kind("f").alias("kind"))


@query("p20_code_shape", "SELECT p_partkey, regexp_full_match(code, '[A-Z][A-Z0-9]{2,}') AS is_code FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('C', cast(p_partkey AS varchar)) ELSE p_name END AS code FROM part)")
def _(t):
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", tx.looks_like_code(code).alias("is_code"))


def _label_sql():
    from ..fixed_values import LINE_LABELS

    whens, values = [], []
    for field, words in LINE_LABELS.items():
        for w in words:
            whens.append(f"WHEN starts_with(line, '{w}') THEN '{field}'")
            values.append(f"WHEN starts_with(line, '{w}') THEN regexp_replace(regexp_replace(substring(line, {len(w) + 1}), '^[\\s\\p{{Z}}：:,，、]+', ''), '[\\s\\p{{Z}}]+$', '')")
    fields = ", ".join(f"coalesce(min_by(value, line_no) FILTER (WHERE field = '{f}' AND value <> ''), '') AS {f}" for f in LINE_LABELS)
    lines = """lines AS (SELECT doc_id, line_no, regexp_replace(line, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS line FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM order_texts)),"""
    tagged = f"tagged AS (SELECT doc_id, line_no, line, CASE {' '.join(whens)} END AS field, CASE {' '.join(values)} END AS value FROM lines)"
    return f"WITH {lines} {tagged} ", fields


LABEL_CTE, LABEL_FIELDS = _label_sql()


@query("p21_labelled_lines", LABEL_CTE + f"SELECT doc_id, {LABEL_FIELDS} FROM tagged WHERE field IS NOT NULL AND value <> '' GROUP BY doc_id", ("order_texts",))
def _(t):
    return ps.labelled_fields(t.order_texts, "doc_id")


@query("p22_item_lines", LABEL_CTE + r""", parts AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS p FROM tagged WHERE field IS NULL),
 num AS (SELECT *, list_max(list_filter(range(2, greatest(len(p) + 1, 3)), lambda i: regexp_full_match(coalesce(p[i], ''), '\d+(\.\d+)?'))) AS qpos FROM parts),
 st AS (SELECT *, CASE WHEN regexp_full_match(coalesce(p[2], ''), '[A-Za-z][A-Za-z0-9]{2,}') THEN 3 ELSE 2 END AS s FROM num WHERE qpos IS NOT NULL AND len(p) >= 3),
 mid AS (SELECT *, CASE WHEN qpos > s THEN p[s:qpos-1] ELSE [] END AS m FROM st),
 cut AS (SELECT *, coalesce(list_min(list_filter(range(1, len(m) + 1), lambda i: regexp_matches(m[i], '(规格|件：|箱：|袋：|kg|KG|g|G|[*×])'))), len(m) + 1) AS c FROM mid)
 SELECT doc_id, line_no, CASE WHEN s = 3 THEN p[2] ELSE '' END AS product_code, array_to_string(m[1:c-1], '') AS product_name, array_to_string(m[c:], ' ') AS spec,
  cast(floor(cast(p[qpos] AS double)) AS bigint) AS quantity, CASE WHEN list_contains(['箱','件','袋','包','个','瓶','桶','条','盒','台'], p[qpos+1]) THEN p[qpos+1] ELSE '件' END AS unit FROM cut
 WHERE regexp_full_match(regexp_replace(p[1], '[.、]+$', ''), '\d+') AND floor(cast(p[qpos] AS double)) > 0 AND array_to_string(m[1:c-1], '') <> ''""", ("order_texts",))
def _(t):
    return ps.item_lines(t.order_texts, "doc_id").withColumn("line_no", F.col("line_no").cast("bigint"))


RAW = "CASE event_id % 5 WHEN 0 THEN concat('x ```json', chr(10), props, chr(10), '``` y') WHEN 1 THEN concat('<think>hm</think> <b>', props, '</b>') WHEN 2 THEN concat('```broken``` ```', props, '```') WHEN 3 THEN 'nothing here' ELSE props END"


@query("p23_salvage_json", f"SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL ELSE props END AS payload FROM events")
def _(t):
    return t.events.select("event_id", F.expr(RAW).alias("raw")).select("event_id", ps.salvage_json("raw").alias("payload"))


ACTION_SQL = """CASE WHEN contains(lower({0}), 'confirm') OR contains({0}, '确认') THEN 'confirm' WHEN contains(lower({0}), 'reject') OR contains({0}, '拒绝') THEN 'reject'
 WHEN contains(lower({0}), 'modify') OR contains({0}, '修改') OR contains({0}, '改') THEN 'modify' WHEN contains(lower({0}), 'yes') OR contains({0}, '对') OR contains({0}, '正确') THEN 'accept'
 WHEN contains(lower({0}), 'no') OR contains({0}, '错') THEN 'reject' END"""


@query("p24_user_action", f"SELECT session_id, turn, {ACTION_SQL.format('content')} AS action FROM messages", ("messages",))
def _(t):
    return t.messages.select("session_id", "turn", ps.user_action("content").alias("action"))


@query("p25_edit_instruction", r"""SELECT session_id, turn, CASE WHEN k = 4 THEN 'confirm' WHEN k IN (2, 3) THEN 'modify' ELSE 'ask' END AS action, cast(CASE k WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS bigint) AS n_edits,
  CASE k WHEN 2 THEN concat(turn + 1, ':quantity:', session_id) WHEN 3 THEN '0:unit_type:large' ELSE '' END AS edits FROM (SELECT *, (session_id + turn) % 8 AS k FROM messages) x""", ("messages",))
def _(t):
    e = t.messages.select("session_id", "turn", ps.edit_instruction("content").alias("e"))
    return e.select("session_id", "turn", "e.action", F.size("e.edits").cast("bigint").alias("n_edits"), F.array_join(
        F.transform("e.edits", lambda x: F.concat_ws(":", x["row"].cast("string"), x["field"], x["new_value"])), "|").alias("edits"))


@query("p26_reasoning_steps", r"""WITH m AS (SELECT session_id, turn, content, regexp_extract_all(content, '(?s)\*\*(?:思|思考|推理|分析|判断)[^*]*?\*\*(.*)$', 1) AS marked FROM messages),
 s AS (SELECT session_id, turn, CASE WHEN len(list_filter(marked, lambda x: length(trim(x)) > 5)) > 0 THEN list_filter(marked, lambda x: length(trim(x)) > 5)
   ELSE list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^\d+[.)]\s+|^-\s+')), lambda x: regexp_replace(x, '^\d+[.)]\s+', '')) END AS steps FROM m)
 SELECT session_id, turn, cast(len(steps) AS bigint) AS n_steps, cast(coalesce(list_sum(list_transform(steps, lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))), 0) AS bigint) AS total_chars FROM s""", ("messages",))
def _(t):
    steps = ps.reasoning_steps("content")
    return t.messages.select("session_id", "turn", F.size(steps).cast("bigint").alias("n_steps"),
                             F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("total_chars"))


@query("p27_args_summary", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('命令: ', substring(concat('run ', props), 1, 50), '...') WHEN 1 THEN concat('门店: s', cast(user_id AS varchar))
  WHEN 2 THEN 'SKU数量: 2' WHEN 3 THEN '输入类型: unknown' ELSE '参数: k' END AS summary FROM events""")
def _(t):
    k = F.col("event_id") % 5
    tool = F.when(k == 0, "exec").when(k == 1, "_match_store").when(k == 2, "_match_sku").when(k == 3, "order_parser").otherwise("other")
    args = (F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("run "), "props").alias("command"))))
            .when(k == 1, F.to_json(F.struct(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("store_name"))))
            .when(k == 2, F.lit('{"items": [1, 2]}')).otherwise(F.col("props")))
    return t.events.select("event_id", ps.args_summary(tool, args, keep_keys=3, keep_command=50).alias("summary"))


@query("p30_version_key", "SELECT skill_version, regexp_replace(trim(skill_version), '^[vV]', '') AS version_key, count(*) AS n FROM order_metrics GROUP BY ALL", ("order_metrics",))
def _(t):
    return t.order_metrics.groupBy("skill_version", tx.version_key("skill_version").alias("version_key")).agg(F.count(F.lit(1)).alias("n"))


@query("p31_rate_of_text", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round(cast(value AS double) / 100, 8) END AS rate FROM events")
def _(t):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("% ")))
    return t.events.select("event_id", F.round(tx.rate_of(text), 8).alias("rate"))


@query("p35_match_score", f"""SELECT a, b, round(least(1.0e0, n * 0.5e0 + 0.5e0 * 0.2e0 + 0.2e0), 6) AS l2, round(least(1.0e0, n * 0.45e0 + 0.5e0 * 0.2e0 + greatest(boost, 0.1e0) * 0.1e0 + 0.1e0), 6) AS l3 FROM (
  SELECT a, b, 2.0e0 * least(length(a), length(b)) / (length(a) + length(b)) AS n, CASE WHEN contains(b, a) THEN 0.25e0 WHEN contains(a, b) THEN 0.1e0 ELSE 0.0e0 END AS boost FROM ({CLEAN_PAIRS}) x WHERE contains(a, b) OR contains(b, a)) y""", ("order_lines", "catalog"))
def _(t):
    a, b = F.col("a"), F.col("b")
    rows = clean_pairs(t).where(a.contains(b) | b.contains(a)).withColumn("n", sim.contained_ratio(a, b)).withColumn("boost", tx.containment_boost(a, b))
    yes, no = F.lit(True), F.lit(False)
    return rows.select("a", "b", F.round(sim.match_score("L2", F.col("n"), F.lit(0.5), F.lit(0.0), yes, no), 6).alias("l2"),
                       F.round(sim.match_score("L3", F.col("n"), F.lit(0.5), F.greatest("boost", F.lit(0.1)), no, yes), 6).alias("l3"))
