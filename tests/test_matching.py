"""The cascade and its blocking joins against brute force, with invented names."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from orderloom.operators import sku_match as sm
from orderloom.operators.blocking import containment_join, salted_join, similar_pairs
from orderloom.operators.ranking import best_with_ties, pages

FORMS, SEASONINGS = ["鱼片", "鸡排", "片", "鱼", "肉"], ["酱料", "粉"]
PIECES = ["红", "烧", "鱼", "片", "鸡", "排", "金", "汤", "酱料", "粉", "肉", "5kg", "2L", "大", "小", "A"]


def make_names(rnd, n):
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def fixture(spark):
    rnd = random.Random(5)
    names = make_names(rnd, 60)
    catalog = []
    for i, n in enumerate(names + names[:15]):
        catalog.append(dict(
            owner_code=f"O{i % 2}", sku_code=f"SK{i:04d}", customer_code=f"C{i}", sku_name=n, unit=rnd.choice(["箱", "包", "件"]),
            unit_type=None, conversion_ratio=float(rnd.choice([1, 6, 12])), product_spec=rnd.choice(["", None, "14包*1KG", "10包/箱", "2KG*6袋"]),
            status="INACTIVE" if i % 13 == 0 else "ACTIVE"))
    lines = []
    for n in names + make_names(rnd, 60):
        shape = rnd.randint(0, 5)
        text = [n, n + "-", n + "（14包*1KG）", n[:-1], "新" + n, n + "(10包/箱)"][shape]
        lines.append((f"O{rnd.randint(0, 1)}", text, rnd.choice(["箱", "包", "件"])))
    lines += [(f"O{i % 2}", "新" + names[i], rnd.choice(["箱", "包", "件"])) for i in range(15)]
    lines += [("O0", "C3", "箱"), ("O1", "  ", "箱"), ("O0", "5kg", "包"), ("O1", "昵称 一", "箱"), ("O0", "（5包）", "件")]
    schema = "owner_code string, sku_code string, customer_code string, sku_name string, unit string, unit_type string, conversion_ratio double, product_spec string, status string"
    cat = spark.createDataFrame([tuple(r.values()) for r in catalog], schema)
    ln = spark.createDataFrame(lines, "owner_code string, product_name string, unit string")
    return catalog, lines, cat, ln


def test_cascade_equals_brute_force(spark, fixture):
    catalog, lines, cat, ln = fixture
    table = spark.createDataFrame([("O1", "昵称 一", catalog[1]["sku_name"])], "owner_code string, order_name string, system_name string")
    files = spark.createDataFrame([], "seq bigint, owner_code string, order_name string, system_name string")
    aliases = {("O1", "昵称一"): [r for r in catalog if r["owner_code"] == "O1" and r["sku_name"] == catalog[1]["sku_name"]]}
    want = plain.resolve(lines, catalog, aliases, FORMS, SEASONINGS)
    got = sm.resolve_keys(sm.line_keys(ln), cat, sm.resolve_aliases(table, files, cat), FORMS, SEASONINGS)
    got = {(r.owner_code, r.name, r.order_unit): (r.layer, round(r.confidence, 6), r.need_confirm, r.n_candidates, r.sku.sku_code) for r in got.collect()}
    assert got == {k: (v[0], round(v[1], 6), *v[2:]) for k, v in want.items()}
    assert {v[0] for v in got.values()} >= {"L0", "L1", "L1b", "L2", "L2.5", "L3"}


def test_candidate_pairs_lose_nothing(spark, fixture):
    catalog, lines, cat, ln = fixture
    keys = sm.line_keys(ln).where("clean <> ''")
    scored = sm.name_scores(sm.candidate_pairs(keys, sm.active_catalog(cat), FORMS, SEASONINGS), FORMS, SEASONINGS)
    got = {(r.owner_code, r.clean, r.sku_name): round(r.name_score, 9) for r in scored.collect()}
    for owner, clean in {(r.owner_code, r.clean) for r in keys.collect()}:
        for r in catalog:
            if r["owner_code"] != owner or r["status"] != "ACTIVE" or not plain.gate(clean, r["sku_name"], FORMS, SEASONINGS):
                continue
            n = plain.ratio(clean, r["sku_name"])
            edge = len(clean) >= 2 and (clean[:2] in r["sku_name"] or clean[-2:] in r["sku_name"])
            if n >= 0.5 or edge:
                assert got[(owner, clean, r["sku_name"])] == round(n, 9)


def test_similar_pairs_keep_every_pair_above_the_floor(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdefg红烧鱼") for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    left = spark.createDataFrame([(rnd.choice("xy"), t) for t in texts[:60]], "k string, a string").distinct()
    right = spark.createDataFrame([(rnd.choice("xy"), t) for t in texts[60:]], "k string, b string").distinct()
    for floor in (0.35, 0.5, 0.8):
        got = {tuple(r) for r in similar_pairs(left, right, ["k"], "a", "b", floor).collect()}
        for k, a in left.collect():
            for k2, b in right.collect():
                if k == k2 and plain.ratio(a, b) >= floor:
                    assert (k, a, b) in got


def test_containment_join_equals_nested_loop(spark):
    rnd = random.Random(3)
    make = lambda n: "".join(rnd.choice("ab鱼片") for _ in range(n))
    needles, hays = {make(rnd.randint(0, 4)) for _ in range(60)}, {make(rnd.randint(0, 8)) for _ in range(80)}
    got = containment_join(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hays], "hay string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, h) for n in needles if n for h in hays if n in h)


def test_hot_keys_are_salted_without_changing_the_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("800", 3)], "k string, w int")
    salted = salted_join(left, right, ["k"], F.col("v"), rows_per_salt=50)
    assert sorted(map(tuple, salted.select("k", "v", "w").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "v", "w").collect()))


def test_ties_and_pages(spark):
    df = spark.createDataFrame([("a", 0.9, "x"), ("a", 0.8999, "b"), ("a", 0.5, "c"), ("z", 0.1, "q")], "k string, s double, code string")
    rows = {r.k: r for r in best_with_ties(df, ["k"], "s", "code", ["s"]).collect()}
    assert (rows["a"].n_tied, rows["a"].tied.code, rows["a"].top.code, rows["z"].n_tied) == (2, "b", "x", 1)
    many = spark.range(2500).select(F.lit("k").alias("k"), "id")
    paged = pages(many, ["k"], F.col("id"), per_page=1000).collect()
    assert len(paged) == 3 and sorted(i for p in paged for i in p["items"]) == list(range(2500))


def test_unit_choice_cases(spark):
    """Same name in several units: the order's unit decides, else all rows are candidates."""
    rows = [("O", "S1", "c1", "果糖", "瓶", None, 1.0, "", "ACTIVE"), ("O", "S2", "c2", "果糖", "件", None, 12.0, "", "ACTIVE"), ("O", "S3", "c3", "果糖", "件", None, 6.0, "", "INACTIVE")]
    cat = spark.createDataFrame(rows, "owner_code string, sku_code string, customer_code string, sku_name string, unit string, unit_type string, conversion_ratio double, product_spec string, status string")
    ln = spark.createDataFrame([("O", "果糖", "件"), ("O", "果糖-", "瓶"), ("O", "果糖", "桶"), ("O", "c1", "件")], "owner_code string, product_name string, unit string")
    got = {(r.product_name, r.unit): (r.sku_code, r.need_confirm, r.match_layer) for r in sm.resolve_lines(ln, cat).collect()}
    assert got == {("果糖", "件"): ("S2", False, "L1"), ("果糖-", "瓶"): ("S1", False, "L1b"), ("果糖", "桶"): ("S1", True, "L1"), ("c1", "件"): ("S1", False, "L1")}
    classes = {r.sku_code: r.unit_type for r in sm.unit_class(cat).collect()}
    assert classes == {"S1": "small", "S2": "large", "S3": "medium"}


def test_file_aliases_rank_below_table_and_last_one_wins(spark):
    rows = [("O", f"S{i}", f"c{i}", n, "件", None, 1.0, "", "ACTIVE") for i, n in enumerate(["甲", "乙", "丙"])]
    cat = spark.createDataFrame(rows, "owner_code string, sku_code string, customer_code string, sku_name string, unit string, unit_type string, conversion_ratio double, product_spec string, status string")
    table = spark.createDataFrame([("O", "a", "甲")], "owner_code string, order_name string, system_name string")
    files = spark.createDataFrame([(1, None, "a", "乙"), (1, None, "b", "乙"), (2, "O", "b", "丙"), (3, "P", "c", "丙"), (4, "O", "d", "甲"), (5, None, "d", "乙")], "seq bigint, owner_code string, order_name string, system_name string")
    got = sorted((r.name, r.sku_name) for r in sm.resolve_aliases(table, files, cat).collect())
    assert got == [("a", "甲"), ("b", "丙"), ("d", "乙")]


def test_only_near_texts_become_pairs(spark):
    """All names share their letters' kinds and lengths: pairs are compared in cells, and only those that can reach the floor become rows."""
    from orderloom.functions.similarity import may_reach

    rnd = random.Random(13)
    names = sorted({"".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(12, 20))) for _ in range(300)})
    left, right = names[::2], names[1::2] + [n[:-1] for n in names[:40:2]]
    want = {(x, y) for x in left for y in right if plain.ratio(x, y) >= 0.75}
    i, j = may_reach(left, right, 0.75)
    assert {(left[p], right[q]) for p, q in zip(i, j)} >= want and len(want) >= 20
    pairs = similar_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(y,) for y in right], "b string"), [], "a", "b", 0.75, rows_per_salt=50)
    rows = [tuple(r) for r in pairs.collect()]
    assert set(rows) >= want and len(rows) == len(set(rows)) < len(left) * len(right) / 5
    long = ["x" * 70 + "".join(rnd.choice("ab") for _ in range(8)) for _ in range(12)]
    i, j = may_reach(long, long, 0.98)
    assert {(p, q) for p in range(12) for q in range(12) if plain.ratio(long[p], long[q]) >= 0.98} <= set(zip(i.tolist(), j.tolist()))


def test_long_needles_meet_few_hays(spark, monkeypatch):
    """Names that share all their 2-grams with many others: needles meet on long grams, so few hays are looked at."""
    from orderloom.operators import blocking

    rnd = random.Random(15)
    hays = sorted({"北门-" + "".join(rnd.choice("0123") for _ in range(rnd.randint(10, 16))) for _ in range(200)})
    needles = [h[rnd.randint(0, 3):len(h) - rnd.randint(0, 3)] for h in hays] + ["1", "32", "012", "门-1", "0123012", "3" * 14]
    met, store = [], blocking.cut_lineage

    def counted(df, name):
        out = store(df, name)
        if name == "rarest":
            met.append(out.agg(F.sum("_salts")).first()[0])
        return out

    monkeypatch.setattr(blocking, "cut_lineage", counted)
    got = containment_join(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hays], "hay string"), rows_per_salt=1)
    want = sorted({(n, h) for n in needles for h in hays if n in h})
    assert sorted(map(tuple, got.collect())) == want
    assert met[0] < 3 * len(want)


def test_few_texts_of_a_key_are_joined_as_rows(spark, monkeypatch):
    """A key with two or three names needs no characters and no cells; a key with many does."""
    from orderloom.operators import blocking

    cells, store = [], blocking.cut_lineage

    def kept(df, name):
        out = store(df, name)
        if name == "cells":
            cells.append(out)
        return out

    monkeypatch.setattr(blocking, "cut_lineage", kept)
    rows = [(f"k{i}", f"name {i} {j}") for i in range(60) for j in range(2)] + [("hot", f"shop {i:03d}") for i in range(150)]
    left, right = spark.createDataFrame(rows, "k string, a string"), spark.createDataFrame(rows, "k string, b string")
    got = {tuple(r) for r in similar_pairs(left, right, ["k"], "a", "b", 0.9).collect()}
    assert got >= {(k, a, b) for k, a in rows for k2, b in rows if k == k2 and plain.ratio(a, b) >= 0.9}
    assert {r.k for r in cells[0].where("_many").select("k").collect()} == {"hot"} and cells[0].where("not _many").count() >= 60


def test_a_filter_on_the_cleaned_name_stays_behind_the_distinct_keys(spark):
    lines = spark.createDataFrame([("o", f"gear{i % 3}-", "箱") for i in range(30)], "owner_code string, product_name string, unit string")
    keys = sm.line_keys(lines).where("clean <> ''")
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "regexp" not in plan
    assert sorted((r.name, r.clean) for r in keys.collect()) == [(f"gear{i}-", f"gear{i}") for i in range(3)]
