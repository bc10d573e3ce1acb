"""Golden values of scalar functions, sheets and documents."""

import random

import pytest
from pyspark.sql import functions as F

from orderloom.functions import parsing as ps
from orderloom.functions import similarity as sim
from orderloom.functions import text as tx
from orderloom.operators import monitoring as mo
from orderloom.operators import normalise as nm
from orderloom.operators.ordered import fill_forward, number_rows, running_count


def values(spark, texts, fn):
    return [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn(F.col("t")).alias("v")).collect()]


@pytest.mark.parametrize("fn,cases", [
    (tx.clean_name, {"果糖-": "果糖", "辣菜D-X-H-": "辣菜D-X-H", "冻品-肉片(1KG*12包/箱)": "冻品-肉片", "茶 （新 款）": "茶", "_./果": "果", "（全）": ""}),
    (tx.scrub, {" 果 糖　 ": "果糖", "​茶\t﻿叶": "茶叶", "": ""}),
    (tx.clean_name_hard, {"茶(a)b(c)-": "茶", "红 茶/大.": "红茶/大", "a★b_c": "ab_c"}),
    (tx.spec_of, {"片14包*1KG": "14包*1KG", "1kg × 12包/箱": "1kg × 12包", "茶（10包/箱）": "10包/箱", "茶（大袋3）": "大袋3", "茶（新款）": "", "茶": ""}),
    (tx.name_core, {"12kg鱼片": "鱼片", "5": "", "鱼5": "鱼5"}),
    (tx.safe_int, {"3件": 3, "2.7": 2, "x": 0, "1.2.3": 0}),
    (tx.first_number, {"数量：3.9": 3, "": 0}),
    (tx.rate_of, {"87.5%": 0.875, "x": 0.0}),
    (ps.user_action, {"Confirm it": "confirm", "I know": "reject", "改一下": "modify", "对": "accept", "hm": None}),
    (ps.salvage_json, {"a ```json\n{\"a\": 1}\n``` b": "{\"a\": 1}", "<think>x</think>[1]": "[1]", "no": None}),
    (ps.first_email, {"Mail A.B@Shop.Example.com now": "a.b@shop.example.com", "x@qq.com": ""}),
    (ps.first_phone, {"tel 13912345678.": "13912345678", "电 010)12345678": "010)12345678", "-": ""}),
    (ps.contact_name, {"联系人：王小明，": "王小明", "经理 李雷": "李雷", "none": ""}),
])
def test_golden(spark, fn, cases):
    assert values(spark, list(cases), fn) == list(cases.values())


def test_edit_instructions(spark):
    got = values(spark, ["确认生成", "算了", "第2行和第5行数量改成7", "所有单位类型都改成large", "hello", "第1行系统SKU改成A7", "第1行SKU改成A7"], ps.edit_instruction)
    assert [g.action for g in got] == ["confirm", "cancel", "modify", "modify", "ask", "modify", "modify"]
    assert [(e.row, e.field, e.new_value) for g in got[5:] for e in g.edits] == [(1, "系统SKU", "A7"), (1, "sku_code", "A7")]
    assert [(e.row, e.field, e.new_value) for e in got[2].edits] == [(2, "quantity", "7"), (5, "quantity", "7")]
    assert [(e.row, e.field, e.new_value) for e in got[3].edits] == [(0, "unit_type", "large")]


def test_item_lines(spark):
    text = "订单编号：A1\n门店名称：花店\n1 P945 椰果 果粒 规格：2kg*10袋 3 件\n2. 茶 0 箱\nx 茶 3\n3、 绿茶 2"
    rows = ps.item_lines(spark.createDataFrame([("d", text)], "id string, text string"), "id").orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in rows] == [("P945", "椰果果粒", "规格：2kg*10袋", 3, "件"), ("", "绿茶", "", 2, "件")]


def test_ratio_is_not_symmetric_and_bounds_hold(spark):
    import itertools
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(7)
    texts = ["tide", "diet", *["".join(rnd.choice("abcd鱼") for _ in range(rnd.randint(1, 8))) for _ in range(30)]]
    df = spark.createDataFrame(list(itertools.product(texts, texts)), "a string, b string")
    a, b = F.col("a"), F.col("b")
    base = df.select("a", "b", sim.length_bound(a, b).alias("l"), sim.shared_char_bound(a, b).alias("c"), sim.contained_ratio(a, b).alias("x")).collect()
    exact = {(r.a, r.b): r.r for r in df.select("a", "b", sim.seq_ratio("a", "b").alias("r")).collect()}
    for r in base:
        true = SequenceMatcher(None, r.a, r.b).ratio()
        assert exact[(r.a, r.b)] == true and r.l >= true and r.c >= true and (r.x is None or r.x == pytest.approx(true, abs=1e-12))
    assert exact[("tide", "diet")] != exact[("diet", "tide")]


def test_ordered_helpers_do_not_depend_on_blocks(spark):
    rows = [("k", i, str(i) if i % 4 == 1 else None) for i in range(1, 40)] + [(None, i, None) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    want = None
    for block in (3, 10, 1000):
        filled = {(r.k, r.i): r.o for r in fill_forward(df, ["k"], "i", "v", "o", block).collect()}
        numbers = {(r.k, r.i): r.n for r in number_rows(df, ["k"], [F.col("i")], F.floor(F.col("i") / block), "n").collect()}
        counts = {(r.k, r.i): r.c for r in running_count(df, ["k"], [F.col("i")], F.floor(F.col("i") / block), F.col("v").isNotNull(), "c").collect()}
        want = want or (filled, numbers, counts)
        assert (filled, numbers, counts) == want
    assert filled[("k", 7)] == "5" and numbers[("k", 39)] == 39 and counts[("k", 10)] == 3 and filled[(None, 3)] is None


def test_reasoning_and_trace_steps(spark):
    msgs = spark.createDataFrame([
        (1, 0, "user", "请修改第2行", None), (1, 1, "assistant", "**思考**a**深入分析一下**", '[{"name":"exec","arguments":"{}"}]'), (1, 2, "assistant", "推理：我在思考这个", None)],
        "session_id int, turn int, role string, content string, tool_calls string")
    steps = {(r.turn, r.step_type): r for r in mo.trace_steps(msgs).collect()}
    assert steps[(0, "user_action")].action == "modify" and steps[(1, "tool_call")].tool_name == "exec"
    assert steps[(2, "reasoning")].content == "推理：我在思考这个"


def test_truth_documents_number_items_over_stores(spark, tmp_path):
    from orderloom.sources import io

    (tmp_path / "a.json").write_text('{"source": "o1",\n "stores": {"甲": {"items": [{"name": "a", "qty": 1, "unit": "件"}, {"name": "b", "qty": 2, "unit": "箱"}]}},\n "ground_truth": {"2": [{"sku": "S2", "unit_type": "large"}]}}', encoding="utf-8")
    rows = io.truth_items(io.read_truth(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [(r.product_name, r.line_no, r.true_sku) for r in rows] == [("a", 1, None), ("b", 2, "S2")]


def test_operation_log_skips_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"order_id": "1", "matched": true, "confidence": 0.5}\n{broken\n{"order_id": "2", "matched": false}\n')
    assert sorted(r.order_id for r in mo.read_operation_log(spark, str(tmp_path)).collect()) == ["1", "2"]


def test_sheet_layouts(spark):
    cells = []

    def sheet(doc, rows):
        for r, row in enumerate(rows, 1):
            cells.extend((doc, r, c, v) for c, v in enumerate(row))

    sheet(1, [["序号", "门店名称", "商品名称", "数量", "单位"], ["1", "甲店", "红 茶", "3", "箱"], ["2", None, "绿茶", "2.0", "件"]])
    sheet(2, [["配送明细表"], ["门店", "品名", "规格", "配送数量"], ["乙店", "椰果", "1KG", "5"]])
    sheet(3, [["单据日期 2024", "", ""], ["往来单位名称", "商品名称", "数量"], ["丙店", "糖", "x"]])
    sheet(4, [["?"], ["a"]])
    df = spark.createDataFrame(cells, "doc_id long, row long, col long, value string")
    got = [(r.doc_id, r.layout, r.store_name, r.product_name, r.quantity) for r in nm.sheet_lines(df).orderBy("doc_id", "row").collect()]
    assert got == [(1, "standard", "甲店", "红茶", 3), (1, "standard", "甲店", "绿茶", 2), (2, "delivery", "乙店", "椰果", 5), (3, "dated", "丙店", "糖", 0)]


def test_numbering_shuffles_rows_once(spark):
    """Rows lie by key and block for the block's offset and for the window inside it; null keys count like others."""
    from orderloom.operators.ordered import number_rows, running_count

    rows = [(k, n, f"v{n}") for k in ("a", "b", None) for n in range(40)]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, value in zip(old, ("false", "-1")):
            spark.conf.set(c, value)
        numbered = number_rows(df, ["k"], [F.col("n")], F.floor(F.col("n") / 7), "i")
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, numbered.collect()), key=str) == sorted([(*r, r[1] + 1) for r in rows], key=str)
        counted = running_count(df, ["k"], [F.col("n")], F.floor(F.col("n") / 7), F.col("n") % 2 == 0, "c")
        assert sorted(map(tuple, counted.collect()), key=str) == sorted([(*r, r[1] // 2 + 1) for r in rows], key=str)
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    assert plan.count("Exchange hashpartitioning(") == 4  # the rows once, the counts, the offsets and their key


def test_pair_bound_loses_no_pair(spark):
    rnd = random.Random(9)
    draw = lambda: "".join(rnd.choice("ab一c") for _ in range(rnd.choice([0, 1, 4, 12, 63, 64, 65, 80])))
    x, y = [draw() for _ in range(400)], [draw() for _ in range(400)]
    for floor in (0.3, 0.6, 0.9):
        for cells in (50, 1 << 21):
            kept = sim.pairs_may_reach(x, y, floor, cells)
            assert all(k for a, b, k in zip(x, y, kept) if a and b and 2 * sim.matched_characters(a, b) / (len(a) + len(b)) >= floor)
            assert not kept.all()


def test_near_tiles_keep_every_near_pair_and_stay_small(monkeypatch):
    """Long and short texts of one cell: a tile has bounded rows and characters, and tiles of too unequal lengths are left out."""
    import plain

    rnd = random.Random(21)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((1, 3, 9, 12, 14, 90)))) for _ in range(150)]
    x, y = texts[:80], texts[80:] + [t[1:] for t in texts[:30] if len(t) > 1]
    met, whole = [], sim.may_reach

    def seen(some, others, floor):
        met.append((some, others))
        return whole(some, others, floor)

    monkeypatch.setattr(sim, "may_reach", seen)
    got = {(int(p), int(q)) for i, j in sim.near_tiles(x, y, 0.7, rows=20, characters=200) for p, q in zip(i, j)}
    assert got >= {(p, q) for p in range(len(x)) for q in range(len(y)) if plain.ratio(x[p], y[q]) >= 0.7}
    assert all(len(side) <= 20 and (len(side) == 1 or sum(map(len, side)) <= 200) for pair in met for side in pair)
    assert sum(len(a) * len(b) for a, b in met) < len(x) * len(y) * 0.8


def test_one_worker_judges_and_scores_a_pair(spark):
    pairs = spark.createDataFrame([("abcd", "abce"), ("abcd", "wxyz"), ("abc", "abcd"), (None, "a"), ("", "a"), ("abcdefgh", "hgfedcba")], "a string, b string")
    scored = sim.with_ratio(pairs, "a", "b", 0.5, "r")
    assert {(r.a, r.b): r.r for r in scored.collect()} == {("abcd", "abce"): 0.75, ("abc", "abcd"): 6 / 7}
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
