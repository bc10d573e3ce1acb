"""Store layers against brute force and by cases, with invented names."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from orderloom.functions import text as tx
from orderloom.operators import store_match as st

STORE = "store_code string, store_name string, owner_code string, phone string, address string, contact_person string, warehouse string"
REQUEST = "request_id string, store_name string, phone string, address string, contact_person string, company string"
OWNER = "customer_id string, customer_name string, status string"
PIECES = ["沛县", "云山", "茶语", "小店", "大道", "北门", "西街", "南", "花"]


def make_store(rnd, i):
    name = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(2, 5)))
    return (f"S{i:03d}", name, f"O{i % 3}", rnd.choice(["", "1390001", "1390002", f"138{i:04d}"]), rnd.choice(PIECES) + "路" + str(i), f"人{i}", f"W{i % 4}")


def test_phone_layer_equals_brute_force(spark):
    rnd = random.Random(1)
    stores = [make_store(rnd, i) for i in range(50)]
    asks = [(f"R{i}", "".join(rnd.choice(PIECES) for _ in range(3)) if i % 3 else rnd.choice(stores)[1], rnd.choice(["1390001", "1390002", "1380003", ""]), "", "", "") for i in range(40)]
    for brands in ((), ("茶语", "云山")):
        got = {r.request_id: (r.store_code, r.match_type, r.need_confirm, r.n_candidates) for r in st.by_phone(
            spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE), brands).collect()}
        want = {}

        def bare(s):
            hit = next((b for b in brands if s.startswith(b)), None)
            return s[len(hit):].lstrip("-").strip() if hit else s

        for rid, name, phone, *_ in asks:
            same = [s for s in stores if phone and s[3] == phone]
            if not same:
                continue
            scored = []
            for s in same:
                sim = plain.ratio(name, s[1])
                scored.append((sim if sim >= 0.6 else max(sim, plain.ratio(bare(name), bare(s[1]))), s[0]))
            best, code = min((-x, c) for x, c in scored)
            if -best >= 0.8:
                want[rid] = (code, "phone_exact_high_conf", False, 1)
            elif -best >= 0.6:
                many = len(same) > 1
                want[rid] = (code, "phone_exact_multi" if many else "phone_exact", True, sum(x >= 0.5 for x, _ in scored) if many else 1)
        assert got == want


def hot_phone(n):
    """Stores of one phone with names much alike, and requests: their names, names near them, and others."""
    stores = [(f"S{i:03d}", f"{PIECES[i % 9]}大道小店{i:03d}", "O1", "1390001", "", "", "W1") for i in range(n)]
    asks = [(f"R{i}", name, "1390001", "", "张三", "") for i, name in enumerate(
        [s[1] for s in stores] + [s[1] + "x" for s in stores] + ["大道小", "大道小店1", "沛县大道小店00", "qq", "云山茶语花00", ""])]
    return stores, asks


def compared(monkeypatch):
    """Numbers of pairs whose ratio is asked for from now on."""
    seen, real = [], st.sim.with_ratio
    monkeypatch.setattr(st.sim, "with_ratio", lambda pairs, *rest, **more: seen.append(pairs.count()) or real(pairs, *rest, **more))
    return seen


def test_names_with_a_near_store_are_not_compared_with_all_of_a_phone(spark, monkeypatch):
    stores, asks = hot_phone(60)
    seen = compared(monkeypatch)
    got = {r.request_id: (r.store_code, r.match_type, r.n_candidates) for r in st.by_phone(
        spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE)).collect()}
    back = {r.request_id: (r.store_code, r.match_type, r.n_candidates) for r in st.by_contact_phone(
        spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE)).collect()}
    want, want_back = {}, {}
    for rid, name, *_ in asks:
        scored = sorted((-plain.ratio(name, s[1]), s[0]) for s in stores)
        best, code = -scored[0][0], scored[0][1]
        n = sum(-x >= 0.5 for x, _ in scored)
        want_back[rid] = (code, "phone_exact_high_conf", 1) if best >= 0.8 else (code, "phone_exact_multi", n)
        if name and best >= 0.6:
            want[rid] = (code, "phone_exact_high_conf", 1) if best >= 0.8 else (code, "phone_exact_multi", n)
    assert got == want and back == want_back
    assert sum(seen) < 9_000  # 125 names and 60 stores: all pairs of both steps are 15 000


def test_cross_keywords_equal_brute_force(spark):
    rnd = random.Random(2)
    stores = [make_store(rnd, i) for i in range(60)]
    asks = [(f"R{i}", "".join(rnd.choice(PIECES + ["牌"]) for _ in range(rnd.randint(1, 4))), "", "", "", "") for i in range(40)]
    got = {r.request_id: (r.store_code, round(r.similarity, 9)) for r in st.by_cross_keywords(
        spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE), ["牌"]).collect()}
    import re

    want = {}
    for rid, name, *_ in asks:
        words = re.findall(r"[一-龥]{2,4}", name.replace("牌", ""))[:3]
        scored = []
        for s in stores:
            if any(w in s[1] for w in words):
                q, o = ({x[i:i + 2] for i in range(len(x) - 1)} for x in (name, s[1]))
                score = 0.5 * (len(q & o) / len(q) if q else 0) + 0.5 * plain.ratio(name, s[1])
                if score >= 0.35:
                    scored.append((-score, s[0]))
        if scored:
            score, code = min(scored)
            want[rid] = (code, round(-score, 9))
    assert got == want


def test_cascade_cases(spark):
    stores = spark.createDataFrame([
        ("S1", "云山茶语小店", "O1", "1390001", "沛县大道1号", "甲", "W1"), ("S2", "云山花店", "O1", "1390002", "北门2号", "乙", "W1"),
        ("S3", "西街面馆", "O2", "1390003", "西街3号", "丙", "W2"), ("S4", "西街面馆", "O2", "1390003", "西街4号", "丁", "W2"),
        ("S5", "南城店", "O3", "", "南城5号", "戊", "W3")], STORE)
    owners = spark.createDataFrame([("O3", "南方食品公司", "ACTIVE"), ("O1", "云山集团", "INACTIVE")], OWNER)
    asks = spark.createDataFrame([
        ("exact", "云山花店", "", "", "", ""), ("many", "西街面馆", "", "", "", ""), ("part", "茶语小", "", "", "", ""),
        ("phone", "云山茶语小", "1390001", "", "", ""), ("wrong phone", "西街面馆x", "1390002", "", "", ""), ("bad name", "店铺1", "", "北门外", "", ""),
        ("company", "无此名字", "", "", "", "南方"), ("cross", "小店 云山", "", "", "", ""), ("fallback", "啊啊啊啊", "1390002", "", "联系人", ""),
        ("none", "啊啊啊啊", "", "", "", "")], REQUEST)
    got = {r.request_id: (r.store_code, r.match_type, r.need_confirm) for r in st.match_stores(asks, stores, owners).collect()}
    assert got["exact"] == ("S2", "exact", False)
    assert got["many"] == ("S3", "exact", True)
    assert got["part"] == ("S1", "fuzzy_contains", False)
    assert got["phone"] == ("S1", "phone_exact_high_conf", False)
    assert got["company"] == ("S5", "customer_company", False)
    assert got["cross"][1] == "keyword_cross"
    assert got["fallback"] == ("S2", "phone_exact", False)
    assert got["none"] == (None, "unmatched", True) and got["wrong phone"][0] != "S2"


def test_confirmations_never_leak(spark):
    """A confirmation belongs to one store of one order."""
    matches = spark.createDataFrame([("o1", "k1", "A", "S1"), ("o1", "k2", "B", "S2"), ("o2", "k1", "A", "S1")], "order_id string, store_key string, store_name string, store_code string")

    def run(rows):
        conf = spark.createDataFrame(rows, "order_id string, confirm_key string, submitted_name string, confirmed_code string, seq int")
        return {(r.order_id, r.store_key): r.final_code for r in st.with_confirmations(matches, conf).collect()}

    base = {("o1", "k1"): "S1", ("o1", "k2"): "S2", ("o2", "k1"): "S1"}
    assert run([("o1", "k1", "", "X", 1)]) == {**base, ("o1", "k1"): "X"}
    assert run([("o1", "B", "", "X", 1)]) == {**base, ("o1", "k2"): "X"}
    assert run([("o1", "zz", "A", "X", 1)]) == {**base, ("o1", "k1"): "X"}
    assert run([("o1", "other", "", "X", 1)]) == base
    assert run([("o1", "k1", "", "X", 1), ("o1", "k1", "", "Y", 2)]) == {**base, ("o1", "k1"): "Y"}


def test_warehouse_part_and_address_words(spark):
    df = spark.createDataFrame([("大铁牛郑州仓",), ("仓",), ("无",)], "n string")
    got = [r.p and tuple(r.p) for r in df.select(st.warehouse_part(F.col("n"), reach=2).alias("p")).collect()]
    assert got == [("郑州仓", "大铁牛"), None, None]
    words = spark.createDataFrame([("江苏省 徐州市沛县 大路",)], "a string").select(tx.address_words("a").alias("w"), tx.address_keywords("a").alias("k")).first()
    assert words.w == ["徐州市沛县", "江苏省", "大路"] and words.k == ["徐州市沛"]


def test_address_layer_equals_brute_force(spark):
    import re

    rnd = random.Random(8)
    stores = [make_store(rnd, i) for i in range(40)]
    asks = [(f"R{i}", "", "", rnd.choice([rnd.choice(stores)[4], rnd.choice(PIECES) + "路" + rnd.choice(PIECES), "沛县 " + rnd.choice(PIECES) + "9"]), "", "") for i in range(30)]
    for preferred in ((), ("花",)):
        got = {r.request_id: (r.store_code, round(r.similarity, 9)) for r in st.by_address(
            spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE), preferred).collect()}
        want = {}
        for rid, _, _, address, *_ in asks:
            for word in sorted(re.findall(r"[一-龥]{2,}", address), key=len, reverse=True):
                hits = [s for s in stores if word in s[1]]
                if not hits:
                    continue
                liked = [s[0] for s in hits if any(p in s[1] for p in preferred)]
                score, code = min((-plain.ratio(address, s[4]), s[0]) for s in hits)
                want[rid] = (min(liked), 0.0) if liked else (code, round(-score, 9))
                break
        assert got == want


def test_similar_names_meet_without_a_key(spark):
    """Every name starts with the same character, which both whole sides hold: it is dealt on a grid."""
    from orderloom.operators.blocking import containment_join, nearest_by_ratio, salted_join, similar_pairs

    rnd = random.Random(12)
    names = sorted({"店" + "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 4))) for _ in range(90)})
    left, right = spark.createDataFrame([(n,) for n in names[::2]], "a string"), spark.createDataFrame([(n,) for n in names[1::2]], "b string")
    every = {(a, b): plain.ratio(a, b) for a in names[::2] for b in names[1::2]}
    got = {tuple(r) for r in similar_pairs(left, right, [], "a", "b", 0.6, rows_per_salt=4).collect()}
    assert got >= {p for p, s in every.items() if s >= 0.6}
    near = {(r.a, r.b): round(r.score, 9) for r in nearest_by_ratio(left, right, [], "a", "b").collect()}
    best = {a: max(s for (x, _), s in every.items() if x == a) for a in names[::2]}
    assert near == {(a, b): round(s, 9) for (a, b), s in every.items() if s == best[a]}
    inside = containment_join(spark.createDataFrame([("店",), ("花",), ("小店",)], "needle string"), right.withColumnRenamed("b", "hay"), rows_per_salt=3)
    assert {tuple(r) for r in inside.collect()} == {(n, h) for n in ("店", "花", "小店") for h in names[1::2] if n in h}
    hot = spark.range(400).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    other = spark.range(300).select(F.lit("k").alias("k"), F.col("id").alias("w"))
    met = salted_join(hot, other, ["k"], F.col("v"), 50, F.col("w"))
    assert met.count() == met.distinct().count() == 400 * 300


def test_owners_by_similar_name(spark):
    owners = spark.createDataFrame([("O1", "南方食品公司", "ACTIVE"), ("O2", "南方食品有限公司", "ACTIVE"), ("O3", "南方食品公司", "INACTIVE"), ("O4", "云山", "ACTIVE")], OWNER)
    asks = spark.createDataFrame([("a", "南方食品厂", "", "", "", ""), ("b", "", "", "", "", "")], REQUEST)
    got = {(r.request_id, r.customer_id): round(r.similarity, 6) for r in st.similar_owners(asks, owners, 0.6).collect()}
    assert got == {("a", o): round(plain.ratio("南方食品厂", n), 6) for o, n in (("O1", "南方食品公司"), ("O2", "南方食品有限公司")) if plain.ratio("南方食品厂", n) >= 0.6}


def test_crossed_names_of_one_word_do_not_all_pair(spark, monkeypatch):
    """All names share one place word and most have a store nearly like them: best first, few pairs are scored."""
    rnd = random.Random(14)
    tails = sorted({"".join(rnd.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(80)})
    stores = [(f"S{i:03d}", f"云山{t}{rnd.choice(PIECES)}", "O", "", "", "", "W") for i, t in enumerate(tails)]
    asks = [(f"R{i:03d}", s[1] + "x" if i % 9 else f"云山{i}", "", "", "", "") for i, s in enumerate(stores)]
    scored, store = [], st.cut_lineage

    def counted(df, name):
        out = store(df, name)
        if name == "cross-pairs":
            scored.append(out.count())
        return out

    monkeypatch.setattr(st, "cut_lineage", counted)
    got = {r.request_id: (r.store_code, round(r.similarity, 9)) for r in st.by_cross_keywords(
        spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE)).collect()}
    want = {}
    for rid, name, *_ in asks:
        best = []
        for s in stores:
            q, o = ({x[i:i + 2] for i in range(len(x) - 1)} for x in ("".join(c for c in y if "一" <= c <= "龥") for y in (name, s[1])))
            best.append((-(0.5 * len(q & o) / len(q) + 0.5 * plain.ratio(name, s[1])), s[0]))
        score, code = min(best)
        if -score >= 0.35:
            want[rid] = (code, round(-score, 9))
    assert got == want and len(got) > 60
    assert sum(scored) < len(asks) * len(stores) / 4


def test_requests_without_a_store_do_not_meet_in_one_task(spark):
    """The store's facts are looked up by the rows that have a store; the others never get to that join."""
    from orderloom.operators import evaluation as ev

    stores = spark.createDataFrame([("S1", "O1", "W1"), ("S2", "O1", "W2")], "store_code string, owner_code string, warehouse string")
    houses = spark.createDataFrame([("W1", "1")], "warehouse_name string, warehouse_code string")
    truth = spark.createDataFrame([(i, "S1") for i in range(200)], "request_id bigint, true_store string")
    results = spark.createDataFrame([(0, "S1"), (1, "S2"), (2, None)], "request_id bigint, store_code string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, value in zip(old, ("false", "-1")):
            spark.conf.set(c, value)
        out = ev.store_truth(results, truth, stores, houses)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.request_id: tuple(r)[1:] for r in out.collect()}
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    assert got == {i: {0: (True, True, True, True), 1: (False, True, True, False)}.get(i, (False, False, True, False)) for i in range(200)}
    assert plan.split("Join LeftOuter, (")[1].startswith("true_store")  # the requests' last join; it was the one by store_code


def test_requests_of_a_name_choose_among_its_stores_once(spark, monkeypatch):
    """Many requests and many stores share a name: what is stored has a row a name, and every request its own row."""
    stored, store = {}, st.cut_lineage

    def kept(df, name):
        stored[name] = out = store(df, name)
        return out

    monkeypatch.setattr(st, "cut_lineage", kept)
    monkeypatch.setattr(st, "ROWS_PER_CELL", 10, raising=False)
    stores = [(f"S{i:03d}", "云山茶语小店", "O", "", "", "", "W") for i in range(40)] + [("T1", "云山茶语花店", "O", "", "", "", "W"), (None, "南方", "O", "", "", "", "W"), ("T2", "南方", "O", "", "", "", "W")]
    asks = [(f"R{i:03d}", "云山茶语小", "", "", "", "") for i in range(50)] + [("R000", "南方店", "", "", "", ""), (None, "南方店", "", "", "", ""), ("Q", "南方店", "", "", "", "")]
    requests, known = spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE)
    got = sorted(tuple(r)[:2] + (round(r.similarity, 6), r.need_confirm, r.n_candidates) for r in st.similar_names(requests, known, 0.95, 0.7).collect())
    near = round(plain.ratio("云山茶语小", "云山茶语小店"), 6)
    assert sorted(got, key=lambda r: r[0]) == [("Q", None, 0.8, True, 2), ("R000", "S000", near, True, 43), *((f"R{i:03d}", "S000", near, True, 41) for i in range(1, 50))]
    assert max(df.count() for name, df in stored.items() if name != "open") <= 3
    pairs = st.similar_candidates(requests, known, 0.7)
    assert sorted((r.request_id or "", r.store_code or "", r.store_name, round(r.score, 6)) for r in pairs.collect()) == sorted(
        (a[0] or "", s[0] or "", s[1], round(plain.ratio(a[1], s[1]), 6)) for a in asks for s in stores if plain.ratio(a[1], s[1]) >= 0.7)


@pytest.mark.parametrize("most", [2, 500])
def test_crossed_names_meet_the_stores_that_have_all_their_grams(spark, monkeypatch, most):
    """Most names have a store that no other can pass: they meet few stores, and only the others go on to be compared with all of a word."""
    rnd = random.Random(31)
    numbers = [f"{rnd.randint(1, 25)}-{rnd.randint(1000, 99999)}" for _ in range(150)] + ["7-77777", "7-777", "12-1212"]
    stores = [(f"S{i:03d}", f"{rnd.choice(('BUILDING', 'SHOP', 'STORE'))}-N_{n}", "O", "", "", "", "W") for i, n in enumerate(numbers)]
    stores += [stores[0][:1] + (None,) + stores[0][2:], (None,) + stores[5][1:], ("A", stores[7][1], "O", "", "", "", "W")]
    names = [s[1] for s in stores if s[1]]
    asks = [n[:-1] for n in names[:40]] + [n + "-X" for n in names[40:80]] + ["QQ" + n.split("-")[-1] for n in names[80:]] + ["ZZ 7777", "X12", "none", "", None, "QQ00", names[3], names[3]]
    asks = [(f"R{i}", name, "", "", "", "") for i, name in enumerate(asks)]
    stored, store = {}, st.cut_lineage

    def kept(df, name):
        stored[name] = out = store(df, name)
        return out

    monkeypatch.setattr(st, "cut_lineage", kept)
    monkeypatch.setattr(st, "STORES_PER_KEY", most, raising=False)
    hits = st.by_cross_keywords(spark.createDataFrame(asks, REQUEST), spark.createDataFrame(stores, STORE), char_class="0-9").collect()
    got = {r.request_id: (r.store_code, round(r.similarity, 9)) for r in hits}
    import re

    want = {}
    for rid, name, *_ in asks:
        words = re.findall("[0-9]{2,4}", name or "")[:3]
        scored = []
        for s in stores:
            if s[0] and s[1] and any(w in s[1] for w in words):
                q, o = ({x[i:i + 2] for i in range(len(x) - 1)} for x in ("".join(c for c in y if c.isdigit()) for y in (name, s[1])))
                score = 0.5 * len(q & o) / len(q) + 0.5 * plain.ratio(name, s[1])
                if score >= 0.35:
                    scored.append((-score, s[0]))
        if scored:
            score, code = min(scored)
            want[rid] = (code, round(-score, 9))
    assert got == want and len(got) > 100
    assert stored["cross-rest"].select("a").distinct().count() < len({a[1] for a in asks}) / 3
