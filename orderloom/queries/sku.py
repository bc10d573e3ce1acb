"""Line-to-catalog queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import analytics as an
from ..operators import evaluation as ev
from ..operators import ranking as rk
from ..operators import review as rv
from ..operators import sku_match as sm
from ..operators import store_match as st
from ..operators.blocking import containment_join
from ..operators.ordered import number_groups, number_rows
from ..session import cut_lineage, work_path
from . import query
from .scalars import CLEAN, RATIO, SCRUB, SPEC

ALL = ("order_lines", "catalog", "table_aliases", "file_aliases")

ALIASES = f"""active AS (SELECT * FROM catalog WHERE status = 'ACTIVE'),
ta AS (SELECT a.owner_code, a.name, c.sku_code, c.sku_name, c.unit, c.unit_type, c.product_spec FROM (SELECT DISTINCT owner_code, {SCRUB.format('order_name')} AS name, system_name FROM table_aliases) a
  JOIN catalog c ON c.owner_code = a.owner_code AND c.sku_name = a.system_name),
fo AS (SELECT o.owner_code, {SCRUB.format('order_name')} AS name, arg_max(system_name, seq) AS system_name FROM file_aliases f
  JOIN (SELECT DISTINCT owner_code FROM catalog) o ON f.owner_code IS NULL OR f.owner_code = o.owner_code GROUP BY 1, 2),
aliases AS (SELECT * FROM ta UNION ALL SELECT fo.owner_code, fo.name, a.sku_code, a.sku_name, a.unit, a.unit_type, a.product_spec FROM fo
  JOIN active a ON a.owner_code = fo.owner_code AND a.sku_name = fo.system_name
  WHERE NOT EXISTS (SELECT 1 FROM ta WHERE ta.owner_code = fo.owner_code AND ta.name = fo.name))"""

KEYS = f"""keys AS (SELECT *, {CLEAN.format('name')} AS clean, {SPEC.format('name')} AS order_spec FROM (
  SELECT DISTINCT owner_code, {SCRUB.format('product_name')} AS name, coalesce(unit, '件') AS order_unit FROM order_lines) k WHERE name <> '')"""

HITS = """hits AS (SELECT k.*, 0 AS lr, a.sku_code, a.unit AS sku_unit, coalesce(a.product_spec, '') AS sku_spec FROM keys k JOIN aliases a ON a.owner_code = k.owner_code AND a.name = k.name
  UNION ALL SELECT k.*, 1, c.sku_code, c.unit, coalesce(c.product_spec, '') FROM keys k JOIN active c ON c.owner_code = k.owner_code AND c.sku_name = k.name
  UNION ALL SELECT k.*, 1, c.sku_code, c.unit, coalesce(c.product_spec, '') FROM keys k JOIN active c ON c.owner_code = k.owner_code AND c.customer_code = k.name AND c.sku_name <> k.name
  UNION ALL SELECT k.*, 2, c.sku_code, c.unit, coalesce(c.product_spec, '') FROM keys k JOIN active c ON c.owner_code = k.owner_code AND c.sku_name = k.clean WHERE k.clean <> k.name AND k.clean <> ''
  UNION ALL SELECT k.*, 2, c.sku_code, c.unit, coalesce(c.product_spec, '') FROM keys k JOIN active c ON c.owner_code = k.owner_code AND c.customer_code = k.clean AND c.sku_name <> k.clean WHERE k.clean <> k.name AND k.clean <> '')"""

# product-form words of the given names, and the core-word gate with them
FORMS = ("bolt", "gear", "ring")
CORE = "trim(regexp_replace({}, '^[0-9]+[a-zA-Z]*', ''))"
CONTAINED = "(contains(c.sku_name, k.clean) OR contains(k.clean, c.sku_name))"
GATE = f"({CONTAINED} OR contains({CORE.format('c.sku_name')}, {CORE.format('k.clean')}) OR contains({CORE.format('k.clean')}, {CORE.format('c.sku_name')})" + "".join(
    f" OR (contains({CORE.format('k.clean')}, '{w}') AND contains({CORE.format('c.sku_name')}, '{w}'))" for w in FORMS) + ")"

PAIRS0 = f"""pairs0 AS (SELECT k.owner_code, k.name, k.order_unit, k.clean, k.order_spec, c.sku_code, c.sku_name, c.unit AS sku_unit, coalesce(c.product_spec, '') AS sku_spec, {CONTAINED} AS inside
  FROM keys k JOIN active c ON c.owner_code = k.owner_code AND {GATE}
  WHERE k.clean <> '' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.owner_code = k.owner_code AND h.name = k.name AND h.order_unit = k.order_unit))"""
PAIRS = """pairs AS (SELECT p.*, CASE WHEN inside THEN 2.0e0 * least(length(clean), length(sku_name)) / (length(clean) + length(sku_name)) ELSE r.ratio END AS ns
  FROM pairs0 p LEFT JOIN ratios r ON r.a = p.clean AND r.b = p.sku_name)"""

SPEC_RATIO_PAIRS = """SELECT DISTINCT lower(order_spec) AS a, lower(sku_spec) AS b FROM (SELECT order_spec, sku_spec FROM hits WHERE lr = 2 UNION ALL SELECT order_spec, sku_spec FROM pairs0) u
  WHERE order_spec <> '' AND sku_spec <> ''"""
NAME_RATIO_PAIRS = "SELECT DISTINCT clean AS a, sku_name AS b FROM pairs0 WHERE NOT inside"

POINTS = r"""points AS (SELECT a, b, CASE WHEN a = b THEN 1.0e0 WHEN au[1] <> bu[1] THEN 0.3e0 WHEN len(an) > 0 AND an = bn AND au = bu THEN 1.0e0
    WHEN len(an) > 0 AND len(bn) > 0 AND list_sort(list_distinct(an)) = list_sort(list_distinct(bn)) THEN 0.8e0 ELSE ratio END AS points
  FROM (SELECT a, b, ratio, regexp_extract_all(a, '\d+') AS an, regexp_extract_all(b, '\d+') AS bn, regexp_extract_all(a, '[包袋箱件个条]') AS au, regexp_extract_all(b, '[包袋箱件个条]') AS bu FROM ratios) r)"""

EQUAL = """hp AS (SELECT h.*, CASE WHEN order_spec = '' THEN 0.5e0 ELSE coalesce(p.points, 0.5e0) END AS ss FROM hits h LEFT JOIN points p ON p.a = lower(h.order_spec) AND p.b = lower(h.sku_spec)),
fit AS (SELECT *, lr = 2 AND order_spec <> '' AND count(*) OVER w > 1 AND count(CASE WHEN ss >= 0.5 THEN 1 END) OVER w > 0 AS use_fit FROM hp WINDOW w AS (PARTITION BY owner_code, name, order_unit, lr)),
kept AS (SELECT * FROM fit WHERE NOT use_fit OR ss >= 0.5),
chosen AS (SELECT owner_code, name, order_unit, lr, count(*) AS n, count(CASE WHEN sku_unit = order_unit AND order_unit <> '' THEN 1 END) AS u, min(sku_code) AS b, min(CASE WHEN sku_unit = order_unit AND order_unit <> '' THEN sku_code END) AS bu
  FROM kept GROUP BY ALL),
equal_first AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY owner_code, name, order_unit ORDER BY lr) = 1),
equal_result AS (SELECT owner_code, name, order_unit, ['L0', 'L1', 'L1b'][lr + 1] AS layer, [0.98e0, 0.95e0, 0.93e0][lr + 1] AS confidence,
  CASE WHEN n > 1 AND u > 0 THEN bu ELSE b END AS sku_code, CASE WHEN n > 1 AND u > 0 THEN u ELSE n END AS n_candidates, CASE WHEN n > 1 AND u > 0 THEN u ELSE n END > 1 AS need_confirm FROM equal_first)"""

SIMILAR = """sc AS (SELECT pairs.*, CASE WHEN order_spec = '' THEN 0.5e0 ELSE coalesce(p.points, 0.5e0) END AS ss, CASE WHEN contains(sku_name, clean) THEN 0.25e0 WHEN contains(clean, sku_name) THEN 0.1e0 ELSE 0.0e0 END AS boost,
    CASE WHEN sku_unit = order_unit AND order_unit <> '' THEN 0.2e0 ELSE 0.0e0 END AS ub, CASE WHEN order_spec <> '' AND order_spec = sku_spec THEN 0.1e0 ELSE 0.0e0 END AS sb
  FROM pairs LEFT JOIN points p ON p.a = lower(order_spec) AND p.b = lower(sku_spec)),
layered AS (SELECT owner_code, name, order_unit, sku_code, ns, 3 AS lr, least(ns * 0.5e0 + ss * 0.2e0 + 0.0e0 + ub + sb, 1.0e0) AS s FROM sc WHERE contains(sku_name, clean)
  UNION ALL SELECT owner_code, name, order_unit, sku_code, ns, 4, least(ns * 0.45e0 + ss * 0.2e0 + CASE WHEN ns >= 0.7 THEN greatest(boost, 0.25e0) ELSE boost END * 0.1e0 + ub + sb, 1.0e0) FROM sc WHERE ns >= 0.5
  UNION ALL SELECT owner_code, name, order_unit, sku_code, ns, 5, least(ns * 0.45e0 + ss * 0.2e0 + boost * 0.1e0 + ub + sb, 1.0e0) FROM sc
    WHERE length(clean) >= 2 AND (contains(sku_name, left(clean, 2)) OR contains(sku_name, right(clean, 2)))),
topped AS (SELECT *, max(s) OVER (PARTITION BY owner_code, name, order_unit, lr) AS top FROM layered),
best AS (SELECT owner_code, name, order_unit, lr, top, arg_min(ns, sku_code) FILTER (WHERE s = top) AS n, min(sku_code) FILTER (WHERE s = top) AS top_code,
  count(CASE WHEN top - s < 0.001 THEN 1 END) AS n_tied, min(CASE WHEN top - s < 0.001 THEN sku_code END) AS tied_code FROM topped GROUP BY ALL),
judged AS (SELECT *, n_tied > 1 AS tie, lr = 5 AND top >= 0.55 AND top < 0.6 AND n >= 0.7 AS lifted FROM best),
accepted AS (SELECT * FROM judged WHERE CASE WHEN tie THEN top >= CASE WHEN lr = 4 THEN 0.7 ELSE 0.6 END OR n >= 0.7 OR (top >= 0.4 AND n >= 0.6)
  WHEN lr = 4 THEN top >= 0.7 ELSE top >= 0.6 OR lifted END),
similar_result AS (SELECT owner_code, name, order_unit, ['L2', 'L2.5', 'L3'][lr - 2] AS layer,
  CASE WHEN NOT tie AND lifted THEN least(0.79e0, floor((top + 0.2) * 100 + 0.5 + 1e-9) / 100) ELSE least(CASE lr WHEN 4 THEN 0.85e0 WHEN 5 THEN 0.88e0 ELSE 1.0e0 END, floor(top * 100.0e0 + 0.5e0 + 1e-9) / 100.0e0) END AS confidence,
  CASE WHEN tie THEN tied_code ELSE top_code END AS sku_code, n_tied AS n_candidates, tie OR top < 0.8 AS need_confirm
  FROM accepted QUALIFY row_number() OVER (PARTITION BY owner_code, name, order_unit ORDER BY lr) = 1)"""

CASCADE = "WITH RECURSIVE " + ",\n".join([ALIASES, KEYS, HITS, PAIRS0, RATIO.format(pairs=f"{SPEC_RATIO_PAIRS} UNION {NAME_RATIO_PAIRS}")[len("WITH RECURSIVE "):], PAIRS, POINTS, EQUAL, SIMILAR,
    "results AS (SELECT * FROM equal_result UNION ALL SELECT * FROM similar_result)"])

LINES = CASCADE + f""",
lines AS (SELECT l.*, r.layer AS match_layer, coalesce(r.confidence, 0.0e0) AS confidence, coalesce(r.need_confirm, false) AS need_confirm, coalesce(r.n_candidates, 0) AS n_candidates, r.sku_code,
    c.unit AS sku_unit, c.unit_type, r.layer IS NOT NULL AS matched
  FROM order_lines l LEFT JOIN results r ON r.owner_code = l.owner_code AND r.name = {SCRUB.format('l.product_name')} AND r.order_unit = coalesce(l.unit, '件') LEFT JOIN catalog c ON c.sku_code = r.sku_code)"""

# the same up to the cleaned name, without aliases
EQUAL_LINES = "WITH RECURSIVE " + ",\n".join([
    "active AS (SELECT * FROM catalog WHERE status = 'ACTIVE')", "aliases AS (SELECT owner_code, sku_name AS name, sku_code, sku_name, unit, unit_type, product_spec FROM catalog WHERE 1 = 0)", KEYS, HITS,
    RATIO.format(pairs="SELECT DISTINCT lower(order_spec) AS a, lower(sku_spec) AS b FROM hits WHERE lr = 2 AND order_spec <> '' AND sku_spec <> ''")[len("WITH RECURSIVE "):], POINTS, EQUAL]) + f""",
lines AS (SELECT l.*, r.layer AS match_layer, coalesce(r.confidence, 0.0e0) AS confidence, coalesce(r.need_confirm, false) AS need_confirm, r.sku_code, c.unit AS sku_unit, c.unit_type, r.layer IS NOT NULL AS matched
  FROM order_lines l LEFT JOIN equal_result r ON r.owner_code = l.owner_code AND r.name = {SCRUB.format('l.product_name')} AND r.order_unit = coalesce(l.unit, '件') LEFT JOIN catalog c ON c.sku_code = r.sku_code)"""
BASIC = ("order_lines", "catalog")


def aliases(t):
    return sm.resolve_aliases(t.table_aliases, t.file_aliases, t.catalog)


def resolved(t):
    return sm.resolve_lines(t.order_lines, t.catalog, aliases(t), FORMS)


def equal_lines(t):
    return sm.resolve_lines_equal(t.order_lines, t.catalog)


@query("s01_catalog_scan", "SELECT owner_code, sku_code, sku_name, unit, unit_type, conversion_ratio, product_spec, customer_code FROM catalog WHERE status = 'ACTIVE'", ("catalog",))
def _(t):
    return sm.active_catalog(t.catalog)


@query("s03_mapping_scan", "SELECT owner_code, sku_code, sku_name, length(sku_name) AS name_length FROM catalog WHERE status = 'ACTIVE' AND contains(sku_name, 'gear')", ("catalog",))
def _(t):
    return sm.mapping_scan(t.catalog, keyword="gear").orderBy("name_length", "sku_code")


@query("s03_mapping_by_code", "SELECT owner_code, sku_code, sku_name, length(sku_name) AS name_length FROM catalog WHERE status = 'ACTIVE' AND customer_code = 'C77'", ("catalog",))
def _(t):
    return sm.mapping_scan(t.catalog, code="C77")


@query("s03_mapping_of_owner", "SELECT owner_code, sku_code, sku_name, length(sku_name) AS name_length FROM catalog WHERE status = 'ACTIVE' AND owner_code = 'Brand#12'", ("catalog",))
def _(t):
    return sm.mapping_scan(t.catalog, owner="Brand#12")


@query("s04_alias_source", "WITH " + ALIASES + " SELECT owner_code, name, sku_code, sku_name FROM aliases", ("catalog", "table_aliases", "file_aliases"))
def _(t):
    return aliases(t).select("owner_code", "name", "sku_code", "sku_name")


@query("j01_alias_join", "WITH " + ",\n".join([ALIASES, KEYS]) + " SELECT k.owner_code, k.name, k.order_unit, a.sku_code FROM keys k JOIN aliases a ON a.owner_code = k.owner_code AND a.name = k.name", ALL)
def _(t):
    keys = sm.line_keys(t.order_lines).select("owner_code", "name", "order_unit")
    return keys.join(aliases(t), ["owner_code", "name"]).select("owner_code", "name", "order_unit", "sku_code")


@query("j02_exact_match", EQUAL_LINES + " SELECT owner_code, name, order_unit, layer, confidence, sku_code, n_candidates, need_confirm FROM equal_result", BASIC)
def _(t):
    r = sm.resolve_equal(sm.line_keys(t.order_lines), t.catalog)
    return r.select("owner_code", "name", "order_unit", "layer", "confidence", "sku.sku_code", "n_candidates", "need_confirm")


@query("j03_containment_join", f"""SELECT DISTINCT k.owner_code, k.clean, c.sku_name FROM (SELECT DISTINCT owner_code, {CLEAN.format('product_name')} AS clean FROM order_lines) k
  JOIN catalog c ON c.owner_code = k.owner_code AND contains(c.sku_name, k.clean) WHERE c.status = 'ACTIVE' AND k.clean <> ''""", BASIC)
def _(t):
    needles = t.order_lines.select("owner_code", "product_name").distinct().select("owner_code", tx.clean_name("product_name").alias("clean"))
    return containment_join(needles, sm.active_catalog(t.catalog), ["owner_code"], "clean", "sku_name")


GATED = "WITH RECURSIVE " + ",\n".join([ALIASES.split(",\nta AS")[0], KEYS, f"""pairs0 AS (SELECT DISTINCT k.owner_code, k.clean, c.sku_name, {CONTAINED} AS inside FROM keys k JOIN active c ON c.owner_code = k.owner_code AND {GATE} WHERE k.clean <> '')"""])


@query("j04_similarity_join", GATED + ",\n" + RATIO.format(pairs=NAME_RATIO_PAIRS)[len("WITH RECURSIVE "):] + ",\n" + PAIRS + " SELECT owner_code, clean, sku_name, round(ns, 6) AS name_score FROM pairs WHERE ns >= 0.5", BASIC)
def _(t):
    keys = sm.line_keys(t.order_lines).where("clean <> ''")
    scored = sm.name_scores(sm.candidate_pairs(keys, sm.active_catalog(t.catalog), FORMS, edges=False), FORMS)
    return scored.where("name_score >= 0.5").select("owner_code", "clean", "sku_name", F.round("name_score", 6).alias("name_score"))


@query("j05_keyword_join", GATED + " SELECT owner_code, clean, sku_name FROM pairs0 WHERE length(clean) >= 2 AND (contains(sku_name, left(clean, 2)) OR contains(sku_name, right(clean, 2)))", BASIC)
def _(t):
    keys = sm.line_keys(t.order_lines).where("clean <> ''")
    return sm.name_scores(sm.candidate_pairs(keys, sm.active_catalog(t.catalog), FORMS), FORMS).where("edge").select("owner_code", "clean", "sku_name")


@query("w01_layers_of_unlike_names", CASCADE + """ SELECT layer, count(*) AS n, count(DISTINCT r.sku_code) AS n_codes FROM results r JOIN catalog c ON c.sku_code = r.sku_code
  JOIN keys k ON k.owner_code = r.owner_code AND k.name = r.name AND k.order_unit = r.order_unit WHERE layer IN ('L2.5', 'L3') AND NOT (contains(c.sku_name, k.clean) OR contains(k.clean, c.sku_name)) GROUP BY layer""", ALL)
def _(t):
    keys = sm.line_keys(t.order_lines)
    r = sm.resolve_keys(keys, t.catalog, aliases(t), FORMS).where("layer IN ('L2.5', 'L3')").join(keys, sm.KEY)
    unlike = r.where(~(F.col("sku.sku_name").contains(F.col("clean")) | F.col("clean").contains(F.col("sku.sku_name"))))
    return unlike.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sku.sku_code").alias("n_codes"))


@query("j06_match_ladder", r"""WITH names AS (SELECT DISTINCT owner_code, product_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(product_name,
    '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '-+$', ''), '/+$', ''), '\.+$', ''), '[（(].*[)）]', '', 'g'), '[^\p{L}\p{N}_/]', '', 'g') AS clean FROM order_lines),
  steps AS (SELECT owner_code, product_name, sku_code, conversion_ratio, CASE WHEN sku_name = product_name THEN 1 WHEN clean = '' THEN NULL WHEN clean <> product_name AND sku_name = clean THEN 2
    WHEN sku_name <> clean AND starts_with(sku_name, clean) THEN 3 WHEN sku_name <> clean AND ends_with(sku_name, clean) THEN 4 WHEN contains(clean, sku_name) THEN 5 WHEN contains(sku_name, clean) THEN 6 END AS step
    FROM names JOIN catalog USING (owner_code) WHERE status = 'ACTIVE'),
  won AS (SELECT * FROM steps WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner_code, product_name ORDER BY step, conversion_ratio DESC, sku_code) = 1)
  SELECT l.order_id, l.line_no, l.owner_code, l.product_name, cast(step AS bigint) AS step, sku_code FROM order_lines l LEFT JOIN won w ON w.owner_code = l.owner_code AND w.product_name = l.product_name""", BASIC)
def _(t):
    mapping = sm.active_catalog(t.catalog).select("owner_code", F.col("sku_name").alias("mapped_name"), "sku_code", F.col("conversion_ratio").cast("double").alias("ratio"))
    return sm.match_ladder(t.order_lines.select("order_id", "line_no", "owner_code", "product_name"), mapping)


@query("w01_cascade", CASCADE + " SELECT owner_code, name, order_unit, layer, confidence, need_confirm, n_candidates, sku_code FROM results", ALL)
def _(t):
    r = sm.resolve_keys(sm.line_keys(t.order_lines), t.catalog, aliases(t), FORMS)
    return r.select("owner_code", "name", "order_unit", "layer", "confidence", "need_confirm", "n_candidates", "sku.sku_code")


@query("w02_best_with_ties", """WITH s AS (SELECT p_brand, p_partkey, round(p_retailprice / 100) AS score FROM part), m AS (SELECT *, max(score) OVER (PARTITION BY p_brand) AS top FROM s)
  SELECT p_brand, top AS top_score, count(*) AS n_tied, min(p_partkey) AS tied_part FROM m WHERE top - score < 0.001 GROUP BY ALL""")
def _(t):
    scored = t.part.select("p_brand", "p_partkey", F.round(F.col("p_retailprice") / 100).alias("score"))
    best = rk.best_with_ties(scored, ["p_brand"], "score", "p_partkey", ["p_brand"])
    return best.select("p_brand", "top_score", "n_tied", F.col("tied.p_partkey").alias("tied_part"))


@query("w02_tied_rows", """WITH s AS (SELECT p_brand, p_partkey, round(p_retailprice / 100) AS score FROM part), m AS (SELECT *, max(score) OVER (PARTITION BY p_brand) AS top FROM s)
  SELECT p_brand, p_partkey, score, top AS top_score FROM m WHERE top - score < 0.001""")
def _(t):
    scored = t.part.select("p_brand", "p_partkey", F.round(F.col("p_retailprice") / 100).alias("score"))
    return rk.tied_rows(scored, ["p_brand"], "score")


@query("w03_unit_choice", EQUAL_LINES + " SELECT layer, need_confirm, count(*) AS n, sum(n_candidates)::BIGINT AS candidates FROM equal_result GROUP BY ALL", BASIC)
def _(t):
    r = sm.resolve_equal(sm.line_keys(t.order_lines), t.catalog)
    return r.groupBy("layer", "need_confirm").agg(F.count(F.lit(1)).alias("n"), F.sum("n_candidates").alias("candidates"))


@query("w04_unit_class", """SELECT owner_code, sku_code, coalesce(nullif(unit, ''), '件') AS unit, coalesce(nullif(unit_type, ''), CASE WHEN lo = hi OR conversion_ratio = hi THEN 'large' WHEN conversion_ratio = lo THEN 'small' ELSE 'medium' END) AS unit_type
  FROM (SELECT *, min(conversion_ratio) OVER w AS lo, max(conversion_ratio) OVER w AS hi FROM catalog WINDOW w AS (PARTITION BY owner_code, sku_name)) x""", ("catalog",))
def _(t):
    return sm.unit_class(t.catalog)


@query("w06_line_numbers", "SELECT order_id, line_no, supplier_id, true_sku, quantity, amount, row_number() OVER (PARTITION BY order_id ORDER BY line_no, true_sku, supplier_id, quantity, amount) AS seq FROM order_lines", ("order_lines",))
def _(t):
    return numbered(t.order_lines).select("order_id", "line_no", "supplier_id", "true_sku", "quantity", "amount", "seq")


def numbered(lines):
    """Lines with their number in the order. They are stored: numbering reads its rows twice, and matching is costly."""
    lines = cut_lineage(lines, "lines")
    order = [F.col(c) for c in ("line_no", "true_sku", "supplier_id", "quantity", "amount")]
    return number_rows(lines, ["order_id"], order, F.floor(F.col("line_no") / 1000), "seq")


@query("w12_threshold_matches", """SELECT p_brand, p_partkey, round(score, 6) AS score FROM (SELECT p_brand, p_partkey, p_retailprice / 1000 AS score FROM part) x WHERE score >= 0.905
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) <= 3""")
def _(t):
    rows = rk.match_candidates(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], F.col("p_retailprice") / 1000, 0.905, 3, [F.col("p_partkey")])
    return rows.select("p_brand", "p_partkey", F.round("score", 6).alias("score"))


CANDIDATES = """cand AS (SELECT k.owner_code, k.name, k.order_unit, ['L0', 'L1', 'L1b'][k.lr + 1] AS layer, k.sku_code FROM kept k JOIN equal_first e ON e.owner_code = k.owner_code AND e.name = k.name AND e.order_unit = k.order_unit AND e.lr = k.lr
  WHERE CASE WHEN n > 1 AND u > 0 THEN u ELSE n END > 1 AND (NOT (n > 1 AND u > 0) OR k.sku_unit = k.order_unit))"""


@query("n06_candidates", EQUAL_LINES + ",\n" + CANDIDATES + " SELECT owner_code, name, order_unit, array_to_string(list_sort(list(sku_code)), ',') AS codes, count(*) AS n FROM cand GROUP BY ALL", BASIC)
def _(t):
    keys = sm.line_keys(t.order_lines)
    result = sm.resolve_equal(keys, t.catalog)
    rows = sm.equal_candidates(keys, t.catalog, None, result)
    paged = rk.pages(rows, ["owner_code", "name", "order_unit"], F.col("sku_code"))
    return paged.select("owner_code", "name", "order_unit", F.array_join("items", ",").alias("codes"), F.size("items").cast("bigint").alias("n"))


SUMMARY = """SELECT order_id, count(*) AS total_items, count(CASE WHEN matched THEN 1 END) AS matched_count, count(CASE WHEN NOT matched THEN 1 END) AS unmatched_count,
  cast(sum(CASE WHEN NOT matched THEN 1 ELSE CASE WHEN confidence < 0.8 THEN 1 ELSE 0 END + CASE WHEN coalesce(sku_unit, '') = '' THEN 1 ELSE 0 END END) AS bigint) AS alert_count,
  max(NOT matched OR coalesce(sku_unit, '') = '') AS has_critical_alerts FROM lines GROUP BY order_id"""


@query("a17_review_summary_equal_names", EQUAL_LINES + SUMMARY, BASIC)
def _(t):
    return rv.review_summary(equal_lines(t), ["order_id"])


@query("a17_review_summary", LINES + SUMMARY, ALL)
def _(t):
    return rv.review_summary(resolved(t), ["order_id"])


@query("a17_multi_store_summary", LINES + """ SELECT owner_code, count(*) AS total_items, count(CASE WHEN matched AND confidence >= 0.8 THEN 1 END) AS matched_count, count(CASE WHEN matched AND confidence < 0.8 THEN 1 END) AS alert_count,
  count(CASE WHEN NOT matched THEN 1 END) AS unmatched_count FROM lines GROUP BY ALL""", ALL)
def _(t):
    return rv.multi_summary(resolved(t), ["owner_code"])


@query("u01_review_table", EQUAL_LINES + " SELECT order_id, line_no, product_name, sku_code, confidence, matched FROM lines", BASIC)
def _(t):
    # stored, as the table takes the matched and the other rows, and the sort samples both
    r = cut_lineage(equal_lines(t).select("order_id", "line_no", "product_name", "sku_code", "confidence", "matched"), "review")
    table = rv.review_table(r.where("matched").drop("matched"), r.where("not matched").select("order_id", "line_no", "product_name", "confidence"))
    return table.select("order_id", "line_no", "product_name", "sku_code", "confidence", "matched").orderBy("order_id", "line_no")


@query("q03_review_alerts", LINES + """ SELECT order_id, line_no, product_name, alert, CASE WHEN alert = 'low_confidence' THEN 'warning' ELSE 'critical' END AS severity FROM (
  SELECT order_id, line_no, product_name, 'low_confidence' AS alert FROM lines WHERE matched AND confidence < 0.8 UNION ALL SELECT order_id, line_no, product_name, 'unmatched' FROM lines WHERE NOT matched
  UNION ALL SELECT order_id, line_no, product_name, 'empty_field' FROM lines WHERE matched AND coalesce(sku_unit, '') = '') x""", ALL)
def _(t):
    return rv.review_alerts(resolved(t), ["order_id", "line_no", "product_name"])


NUMBERED = ",\nnum AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY line_no, true_sku, supplier_id, quantity, amount) AS seq FROM lines)"


@query("m01_apply_choices", EQUAL_LINES + NUMBERED + """ SELECT order_id, seq, CASE WHEN picked THEN concat('SKX', cast(order_id AS varchar)) ELSE sku_code END AS sku_code, matched OR picked AS matched,
  CASE WHEN picked AND NOT matched THEN 1.0e0 ELSE confidence END AS confidence, CASE WHEN picked AND NOT matched THEN 'fill_unmatched' WHEN picked THEN 'update_existing' ELSE match_layer END AS match_layer
  FROM (SELECT *, order_id % 3 = 0 AND seq = 1 AND order_id % 9 <> 0 AS picked FROM num) x""", BASIC)
def _(t):
    return choices(t)["applied"].select("order_id", "seq", "sku_code", "matched", "confidence", "match_layer")


def choices(t):
    review = numbered(equal_lines(t))
    chosen = t.orders.where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("order_id"), F.lit(1).cast("bigint").alias("seq_no"),
        F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("SKX"), F.col("o_orderkey").cast("string"))).alias("new_sku"),
        F.lit("").alias("new_unit"), F.lit("").alias("new_unit_type"), F.lit(None).cast("bigint").alias("new_quantity"), F.lit(1).alias("seq"))
    review = review.withColumnRenamed("seq", "seq_no")
    return {k: (v.withColumnRenamed("seq_no", "seq") if k == "applied" else v) for k, v in rv.apply_choices(review, chosen, ["order_id", "seq_no"]).items()}


@query("m01_failed_choices", "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 9 = 0 THEN 'missing_required_field' ELSE 'not_found' END AS reason FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 9 = 0 OR NOT EXISTS (SELECT 1 FROM order_lines l WHERE l.order_id = o_orderkey))", ("order_lines",))
def _(t):
    return choices(t)["failed"].select("order_id", "reason")


@query("m02_apply_edits", EQUAL_LINES + NUMBERED + """ SELECT order_id, seq, CASE WHEN order_id % 4 = 0 AND seq = 2 THEN 7 ELSE quantity END AS quantity, CASE WHEN order_id % 6 = 0 THEN 'medium' ELSE unit_type END AS unit_type,
  CASE WHEN order_id % 6 = 0 AND matched THEN coalesce(sku_unit, '件') ELSE sku_unit END AS sku_unit FROM num""", BASIC)
def _(t):
    review = numbered(equal_lines(t))
    o = t.orders.select(F.col("o_orderkey").alias("order_id"))
    edits = o.where("order_id % 4 = 0").select("order_id", F.lit(2).cast("bigint").alias("row"), F.lit("quantity").alias("field"), F.lit("7").alias("new_value"), F.lit(2).alias("seq")).unionByName(
        o.where("order_id % 4 = 0").select("order_id", F.lit(2).cast("bigint").alias("row"), F.lit("quantity").alias("field"), F.lit("9").alias("new_value"), F.lit(1).alias("seq"))).unionByName(
        o.where("order_id % 6 = 0").select("order_id", F.lit(0).cast("bigint").alias("row"), F.lit("unit_type").alias("field"), F.lit("medium").alias("new_value"), F.lit(3).alias("seq")))
    return rv.apply_edits(review, edits, "order_id", "seq", sm.unit_class(t.catalog)).select("order_id", "seq", "quantity", "unit_type", "sku_unit")


def outbound(t):
    """Matched lines; a line's store is its owner, whose warehouse is the one of the owner's first store."""
    lines = cut_lineage(equal_lines(t).where("matched").select("order_id", "line_no", "owner_code", "sku_code", "unit_type", "quantity"), "lines")
    home = t.stores.groupBy("owner_code").agg(F.min_by("warehouse", "store_code").alias("warehouse"))
    coded = st.add_warehouse_code(lines.join(home, "owner_code", "left"), t.warehouses)
    stores = number_groups(coded, ["order_id"], "owner_code", F.col("line_no"), F.floor(F.col("line_no") / 1000), "seq_no")
    return rv.outbound_table(stores.select(
        "seq_no", F.col("owner_code").alias("store_code"), "warehouse_code", "sku_code", "unit_type", "quantity",
        F.col("order_id").cast("string").alias("third_order_no"), F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("remark")))


OUT = ("order_lines", "catalog", "stores", "warehouses")
OUTBOUND_LINES = """,
home AS (SELECT owner_code, arg_min(warehouse, store_code) AS warehouse FROM stores GROUP BY owner_code),
firsts AS (SELECT order_id, owner_code, row_number() OVER (PARTITION BY order_id ORDER BY min(line_no), owner_code) AS seq_no FROM lines WHERE matched GROUP BY order_id, owner_code),
sent AS (SELECT l.*, seq_no, coalesce(warehouse_code, '') AS warehouse_code FROM lines l JOIN firsts f ON f.order_id = l.order_id AND f.owner_code = l.owner_code
  LEFT JOIN home h ON h.owner_code = l.owner_code LEFT JOIN warehouses ON warehouse_name = h.warehouse WHERE matched)"""
OUTBOUND = OUTBOUND_LINES + "SELECT " + ", ".join(
    {"seq_no": "cast(seq_no AS varchar) AS seq_no", "store_code": "owner_code AS store_code", "warehouse_code": "warehouse_code", "sku_code": "sku_code", "unit_type": "coalesce(unit_type, '') AS unit_type",
     "quantity": "cast(quantity AS varchar) AS quantity", "third_order_no": "cast(order_id AS varchar) AS third_order_no", "remark": "concat('line ', cast(line_no AS varchar)) AS remark"}.get(
        c, f"'{fv.OUTBOUND_DEFAULTS.get(c, '')}' AS {c}") for c in fv.OUTBOUND_COLUMNS) + " FROM sent"


@query("s09_outbound_table", EQUAL_LINES + OUTBOUND, OUT)
def _(t):
    return outbound(t)


@query("s10_read_outbound", EQUAL_LINES + OUTBOUND_LINES + " SELECT cast(order_id AS varchar) AS order_no, seq_no AS seq, owner_code AS store_code, sku_code, coalesce(unit_type, '') AS unit_type, quantity FROM sent", OUT)
def _(t):
    path = work_path(t.spark, "outbound")
    rv.write_outbound(outbound(t), path, fmt="parquet")
    return rv.read_outbound(t.spark.read.parquet(path))


@query("w06_store_numbers", "SELECT order_id, supplier_id, dense_rank() OVER (PARTITION BY order_id ORDER BY first, supplier_id) AS store_no, count(*) AS n FROM (SELECT *, min(line_no) OVER (PARTITION BY order_id, supplier_id) AS first FROM order_lines) x GROUP BY order_id, supplier_id, first", ("order_lines",))
def _(t):
    numbered_stores = number_groups(t.order_lines, ["order_id"], "supplier_id", F.col("line_no"), F.floor(F.col("line_no") / 1000), "store_no")
    return numbered_stores.groupBy("order_id", "supplier_id", "store_no").agg(F.count(F.lit(1)).alias("n"))


@query("q08_linked_fields", "SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['vehicle_type'] WHEN 1 THEN ['advance_pay', 'pay_method'] WHEN 2 THEN ['consumer_courier'] ELSE [] END) AS missing_field FROM orders")
def _(t):
    k = F.col("o_orderkey") % 4
    rows = t.orders.select("o_orderkey", F.when(k == 0, "专配").when(k == 1, "快递代发").otherwise("共配").alias("delivery_mode"), F.when(k == 2, "B2C").otherwise("").alias("business_type"),
                           *[F.lit("").alias(c) for c in ("vehicle_type", "advance_pay", "pay_method", "consumer_courier")], F.col("o_orderstatus").alias("phone"), F.col("o_orderpriority").alias("address"))
    from ..operators.normalise import linked_field_errors

    return linked_field_errors(rows, ["o_orderkey"])


@query("a24_names_with_units", "SELECT owner_code, sku_name, count(DISTINCT unit) AS n_units FROM catalog GROUP BY ALL HAVING count(DISTINCT unit) > 1", ("catalog",))
def _(t):
    return t.catalog.groupBy("owner_code", "sku_name").agg(F.count_distinct("unit").alias("n_units")).where("n_units > 1")


TRUTH = """truth AS (SELECT *, coalesce(sku_code = true_sku, false) AS sku_hit, true_unit_type <> '' AS has_unit_truth, coalesce(true_unit_type <> '' AND unit_type = true_unit_type, false) AS unit_hit FROM lines)"""
TOTALS = """SELECT owner_code, count(*) AS total, count(CASE WHEN sku_hit THEN 1 END) AS sku_hits, floor(count(CASE WHEN sku_hit THEN 1 END) * 100.0e0 / count(*) * 100 + 0.5 + 1e-9) / 100 AS sku_hit_pct, count(CASE WHEN has_unit_truth THEN 1 END) AS unit_total,
  floor(coalesce(count(CASE WHEN unit_hit THEN 1 END) * 100.0e0 / nullif(count(CASE WHEN has_unit_truth THEN 1 END), 0), 0) * 100 + 0.5 + 1e-9) / 100 AS unit_hit_pct, floor(count(CASE WHEN need_confirm THEN 1 END) * 100.0e0 / count(*) * 100 + 0.5 + 1e-9) / 100 AS confirm_pct,
  floor(count(CASE WHEN NOT matched THEN 1 END) * 100.0e0 / count(*) * 100 + 0.5 + 1e-9) / 100 AS unmatched_pct FROM truth GROUP BY owner_code"""


@query("j20_truth_join", EQUAL_LINES + ",\n" + TRUTH + " SELECT order_id, line_no, true_sku, sku_hit, unit_hit, NOT matched AS unmatched, need_confirm FROM truth", BASIC)
def _(t):
    return ev.sku_truth(equal_lines(t)).select("order_id", "line_no", "true_sku", "sku_hit", "unit_hit", "unmatched", "need_confirm")


@query("a21_accuracy_totals", LINES + ",\n" + TRUTH + " " + TOTALS, ALL)
def _(t):
    return ev.accuracy_totals(ev.sku_truth(resolved(t)), ["owner_code"])


@query("a22_confidence_bands", LINES + " SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM lines GROUP BY ALL", ALL)
def _(t):
    return ev.confidence_bands(resolved(t))


@query("a18_feedback_record", EQUAL_LINES + """, f AS (SELECT order_id, count(*) AS sku_count, count(CASE WHEN matched THEN 1 END) AS matched_sku_count, max(NOT matched) AS un FROM lines GROUP BY ALL)
  SELECT order_id, sku_count, matched_sku_count, CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END::BIGINT AS store_count, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END::BIGINT AS matched_store_count,
  floor(matched_sku_count / sku_count * 1000000 + 0.5 + 1e-9) / 1000000 AS sku_match_rate, CASE WHEN o_orderstatus <> 'P' THEN 1.0e0 ELSE 0.0e0 END AS store_match_rate, CASE WHEN un THEN '["unmatched"]' ELSE '[]' END AS alerts
  FROM f LEFT JOIN orders ON o_orderkey = order_id""", BASIC)
def _(t):
    stores = t.orders.select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderstatus") != "P").alias("confirmed"))
    return an.feedback_record(equal_lines(t), stores)


def replay(t):
    lines = equal_lines(t).select("order_id", "line_no", "true_sku", "supplier_id", "quantity", "amount", "matched", "sku_code", "unit_type")
    new = cut_lineage(numbered(lines).where("matched").select("order_id", "seq", "sku_code", "unit_type", "quantity"), "replayed")
    k = F.col("order_id")
    old = new.where(k % 10 != 0).withColumn("sku_code", F.when(k % 7 == 0, F.concat("sku_code", F.lit("x"))).otherwise(F.col("sku_code")))
    return old, new.where(k % 11 != 0)


REPLAY = NUMBERED + """, new_o AS (SELECT * FROM num WHERE matched AND order_id % 11 <> 0), old_o AS (SELECT order_id, seq, CASE WHEN order_id % 7 = 0 THEN concat(sku_code, 'x') ELSE sku_code END AS sku_code, quantity FROM num WHERE matched AND order_id % 10 <> 0),
 diff AS (SELECT coalesce(o.order_id, n.order_id) AS order_id, coalesce(o.seq, n.seq) AS seq, o.sku_code AS old_sku, n.sku_code AS new_sku, o.quantity AS old_qty, n.quantity AS new_qty, CASE WHEN o.sku_code IS NOT NULL AND n.sku_code IS NOT NULL THEN o.sku_code = n.sku_code END AS match
  FROM old_o o FULL JOIN new_o n ON o.order_id = n.order_id AND o.seq = n.seq)"""


@query("j22_replay_diff", EQUAL_LINES + REPLAY + " SELECT * FROM diff", BASIC)
def _(t):
    return ev.replay_diff(*replay(t), ["order_id", "seq"]).select("order_id", "seq", "old_sku", "new_sku", "old_qty", "new_qty", "match")


@query("a23_replay_totals", EQUAL_LINES + REPLAY + """, st AS (SELECT order_id, CASE WHEN count(old_sku) = 0 THEN 'no_old_output' WHEN count(new_sku) = 0 THEN 'no_new_output' ELSE 'compared' END AS status, count(match) AS compared, count(CASE WHEN match THEN 1 END) AS consistent FROM diff GROUP BY ALL)
  SELECT status, count(*) AS orders, sum(compared)::BIGINT AS items_compared, sum(consistent)::BIGINT AS items_consistent, floor(coalesce(sum(consistent) * 100.0e0 / nullif(sum(compared), 0), 0) * 10 + 0.5 + 1e-9) / 10 AS accuracy_pct FROM st GROUP BY ALL""", BASIC)
def _(t):
    return ev.replay_totals(ev.replay_status(ev.replay_diff(*replay(t), ["order_id", "seq"]), "order_id"))
