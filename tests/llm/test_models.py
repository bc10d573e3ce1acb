import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import decontaminate, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, score string, row string, n_words string, item string"


def frame(spark, docs, lang="en"):
    return spark.createDataFrame([(i, t, lang, "a", "b", "c", "d") for i, t in docs], SCHEMA)


def prose(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in queries.read(spark, "/root/testdata/sf0.1", "labels").collect()}
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    test = [(got[i]["score"], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    pairs = [(a > b) + (a == b) / 2 for a, y in test if y for b, z in test if not z]
    assert sum(pairs) / len(pairs) > 0.96  # about 2 000 rows are fitted, and some toxic forms stand in none of them
    assert sum(s >= 0.7 for s, y in test if y) >= 0.75 * sum(y for _, y in test)
    assert sum(s >= 0.7 for s, y in test if not y) <= 0.01 * len(test)


def test_toxicity_edges(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(prose(rng, 30) + (["vile", "filth"] if i % 4 == 0 else []) + prose(rng, 30))) for i in range(800)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in docs] + [(None, 1, 1), (5, 1, None), (8, 0, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    more = [(2000, None), (2001, ""), (2002, "Vile, filth!"), (2003, "word " * 70_000 + "vile filth " + "word " * 70_000), (2004, " \n"), (0, docs[0][1]), (None, "vile filth")]
    rows = toxicity.toxicity_report(frame(spark, docs + more), labels).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(rows) == len(docs) + len(more) and got[0][0] == got[0][1]
    assert got[2000] == got[2001] == got[2004] and got[2000][0] < 0.5 < min(got[2002][0], got[2003][0], got[None][0])
    kept = toxicity.without_toxic(frame(spark, docs + more), labels)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if i % 4} | {2000, 2001, 2004}
    none = toxicity.toxicity_report(frame(spark, docs), labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.toxicity_report(frame(spark, docs).limit(0), labels).count() == 0


def plain_leaks(docs, items):
    """Every item against every place of every text."""
    out = set()
    for item_id, text in items:
        item = decontaminate.words_of(text or "")
        if len(item) < decontaminate.LEAST:
            continue
        have = set(item)
        for doc_id, body in docs:
            words = decontaminate.words_of(body or "")
            if doc_id is None or sum(w in have for w in words) < 0.6 * len(item):
                continue
            if any(decontaminate.aligned(item, [], words, p)[0] for p in range(0, max(1, len(words) // decontaminate.STRIDE + 1))):
                out.add((doc_id, item_id))
    return out


def test_decontamination_query_equals_all_places(spark):
    docs = [tuple(r) for r in queries.read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in queries.read(spark, FOLDER, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, FOLDER).collect()}
    want = plain_leaks(docs, items)
    assert len(want) > 10 and got == want


@pytest.mark.parametrize("block", [3, 250])
def test_decontamination_edges(spark, block):
    rng = random.Random(3)
    items = [prose(rng, n) for n in (7, 12, 20, 33, 60, 150)]
    docs, n = [], 0
    for k, item in enumerate(items):
        for change in (0, 1, 3):
            part = list(item)
            for _ in range(change * len(item) // 20):
                part[rng.randrange(len(part) * 2 // 3)] = "other"
            docs.append((n, " ".join(prose(rng, rng.randint(0, 90)) + part + prose(rng, 50))))
            n += 1
    leaks = {(i, i // 3) for i in range(n)}
    docs += [(100 + i, " ".join(prose(rng, 200))) for i in range(20)]
    docs += [(200, None), (201, ""), (202, " ".join(items[4]).upper() + "!"), (203, " ".join(prose(rng, 60_000) + items[2])), (0, docs[0][1]), (None, " ".join(items[3]))]
    bench = spark.createDataFrame([(k, " ".join(t), "x") for k, t in enumerate(items)] + [(50, None, "x"), (51, "too short", "x"), (52, "", "x")], "item_id bigint, text string, passage string")
    rows = decontaminate.find_leaks(frame(spark, docs), bench, block_items=block).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(got) == len(rows) and leaks | {(202, 4), (203, 2)} == got
    clean = decontaminate.without_leaks(frame(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, docs).limit(0), bench).count() == 0


def test_decontamination_of_long_items_and_lists(spark, monkeypatch):
    rng = random.Random(7)
    bench = lambda items: spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    short = [prose(rng, 6) for _ in range(40)]
    listed = frame(spark, [(0, " ".join(w for item in short for w in item)), (1, " ".join(prose(rng, 300)))])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(listed, bench(short)).collect()} == {(0, k) for k in range(40)}
    monkeypatch.setattr(decontaminate, "RANK_LIMIT", 72)
    monkeypatch.setattr(decontaminate, "SPARE_RANK", 8)
    long = [prose(rng, 500) for _ in range(14)]  # 31 passages each: two items a block
    docs = frame(spark, [(k, " ".join(prose(rng, 20) + item + prose(rng, 30))) for k, item in enumerate(long)] + [(100, " ".join(prose(rng, 900)))])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench(long)).collect()} == {(k, k) for k in range(14)}


def plain_share(item, words):
    """Largest share of the item in common with any stretch of the text, by the textbook table."""
    best = 0
    for start in range(max(1, len(words) - len(item) + 1)):
        row = [0] * (len(item) + 1)
        for w in words[start:start + len(item) + len(item) // 4]:
            row = [0] + [max(row[i + 1], 0) if w != item[i] else row[i] + 1 for i in range(len(item))]
            for i in range(len(item)):
                row[i + 1] = max(row[i + 1], row[i])
        best = max(best, row[-1])
    return best / len(item)


def test_decontamination_of_evenly_replaced_words(spark):
    rnd = np.random.default_rng(8)
    word = lambda: f"w{rnd.integers(4_000)}"
    items = [(i, " ".join(word() for _ in range(40)), "yes indeed so it is" if i % 10 == 0 else None) for i in range(60)]
    docs, planted = [], {}
    for i, text, answer in items:
        for rate in (0.2, 0.26, 0.3, 0.7):
            body = [w if k * rate % 1 + rate < 1 else "new" + word() for k, w in enumerate(text.split())]
            filler = [word() for _ in range(100)]
            said = answer.split() if answer and rate == 0.26 else []
            planted[len(docs)] = (i, rate, bool(said) or not answer)
            docs.append((len(docs), " ".join(filler[:50] + body + said + filler[50:])))
        docs.append((len(docs), " ".join(text.split()[:28] + [word() for _ in range(60)])))
        planted[len(docs) - 1] = (i, "beginning", not answer)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, answer string")).collect()}
    words = {d: decontaminate.words_of(t) for d, t in docs}
    for d, i in got:
        assert planted[d][0] == i and plain_share(decontaminate.words_of(items[i][1]), words[d]) >= 0.6
    for rate in (0.2, 0.26, 0.3, "beginning"):
        mine = [(d, p[0]) for d, p in planted.items() if p[1] == rate and p[2]]
        assert len(mine) >= 54 and len(got & set(mine)) >= 0.9 * len(mine), rate
    assert not any(planted[d][1] == 0.7 or not planted[d][2] and planted[d][1] in (0.3, "beginning") for d, _ in got)


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (rng.choices([b"a", b"b", b"c"], k=rng.randint(0, 20)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_quality_counts_weights_and_sample(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.read(spark, FOLDER, "documents").collect()}
    labels = [tuple(r) for r in queries.read(spark, FOLDER, "labels").select("doc_id", "quality").collect()]
    grams = quality.Grams(quality.BUCKETS)
    good, everything = Counter(), Counter()
    marked = {i for i, q in labels if q == 1}
    for i, t in docs.items():
        c = Counter(grams(t or "").tolist())
        everything += c
        if i in marked:
            good += c
    counts = quality.bucket_counts(queries.read(spark, FOLDER, "documents"), queries.read(spark, FOLDER, "labels").where("quality = 1"))
    for have, want in zip(counts, (good, everything)):
        assert have.sum() == sum(want.values()) and all(have[b] == n for b, n in want.items())
    ratios = quality.log_ratios(*counts)
    rows = queries.op9_importance_resampling(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        g = grams(docs[r["doc_id"]] or "")
        assert abs(r["log_weight"] - sum(ratios[b] for b in g.tolist())) < 1e-6
    k = round(len(docs) * sum(q for _, q in labels) / len(labels))
    order = sorted(rows, key=lambda r: -r["gumbel_key"])
    assert {r["doc_id"] for r in rows if r["selected"]} == {r["doc_id"] for r in order[:k]}


def test_quality_counts_all_good_documents(spark):
    n = 20_500
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id")).alias("text"))
    good, everything = quality.bucket_counts(docs, spark.range(n).select(F.col("id").alias("doc_id")))
    grams = quality.Grams(quality.BUCKETS)
    want = np.bincount(np.concatenate([grams(f"common w{i}") for i in range(n)]), minlength=quality.BUCKETS)
    assert good.sum() == 3 * n and everything.sum() == 6 * n and (good == want).all()
    rng = np.random.default_rng(6)
    for numbers in (np.zeros(0, np.int64), np.array([0, 0, 254, 255, 510, 32_767]), rng.integers(0, 1 << 15, 500)):
        assert (quality.restored(quality.shortened(numbers)) == np.sort(numbers)).all()


def test_quality_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "z " * 100_000), (None, "a")]
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.resample(frame(spark, docs), labels, k=3).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and by[1]["log_weight"] == by[2]["log_weight"] == 0 and by[3]["log_weight"] > 0 > by[4]["log_weight"]
    assert sum(r["selected"] for r in rows) in (3, 4)  # a tie at the k-th place stays whole
    assert sum(r["selected"] for r in quality.resample(frame(spark, docs), labels, k=0).collect()) == 0
    assert all(r["log_weight"] == 0 for r in quality.resample(frame(spark, docs), labels.limit(0), k=2).collect())
    assert quality.resample(frame(spark, docs).limit(0), labels).count() == 0
    ratios = np.full(quality.BUCKETS, 0.5)
    for temper, want in ((None, 99_999.5), (400, 200.0), (1e9, 99_999.5)):
        assert {r["log_weight"] for r in quality.weights(frame(spark, [(4, "z " * 100_000)]), ratios, temper).collect()} == {want}


@pytest.mark.parametrize("k", [1, 500, 1999, 2000])
def test_gumbel_top_is_exact(spark, k):
    scored = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 - 3).cast("double").alias("log_weight"))
    rows = quality.gumbel_top(scored, k).collect()
    order = sorted((r["gumbel_key"] for r in rows), reverse=True)
    assert sum(r["selected"] for r in rows) == k and min(r["gumbel_key"] for r in rows if r["selected"]) == order[k - 1]
    assert np.isfinite(order).all()


def test_columns_are_made_orthonormal_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    columns = rng.standard_normal((6_000, 400), np.float32)
    columns[:, :30] *= np.float32(1e4)  # as the items' passages weigh more than the corpus
    columns = columns @ rng.standard_normal((400, 400), np.float32)
    before = columns.copy()
    tracemalloc.start()
    out = decontaminate.orthonormal(columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * before.nbytes
    assert np.abs(out.T @ out - np.eye(400)).max() < 1e-4
    assert np.abs(before - out @ (out.T @ before)).max() < 1e-3 * np.abs(before).max()


def test_product_of_a_gram_matrix_in_many_files_is_few_jobs(spark):
    rows = spark.range(300, numPartitions=120).selectExpr("id AS i", "array(named_struct('j', id, 'w', 2D), named_struct('j', (id + 1) % 300, 'w', 1D)) AS row")
    right = np.random.default_rng(3).standard_normal((300, 4), np.float32)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    got = decontaminate._times(rows, right)
    assert np.allclose(got, 2 * right + np.roll(right, -1, 0), atol=1e-5)
    assert len(tracker.getJobIdsForGroup(None)) - before <= spark.sparkContext.defaultParallelism
