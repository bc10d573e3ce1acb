import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import neighbours, queries


def plain(rows, is_query, k=5):
    """rows: (vec_id, vector)."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, float))
    ids = sorted(good)
    out = {}
    for q in filter(is_query, ids):
        scores = []
        for i in ids:
            n = max(len(good[i]), len(good[q]))
            a, b = (np.pad(x, (0, n - len(x))) for x in (good[i], good[q]))
            scores.append((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i))
        out[q] = [(i, -s) for s, i in sorted(x for x in scores if x[1] != q)[:k]]
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, folder):
    path = f"/root/testdata/{folder}"
    want = plain([tuple(r) for r in queries.read(spark, path, "embeddings").select("vec_id", "embedding").collect()], lambda i: i % 50 == 0)
    got = queries.op3_neighbours(spark, path).collect()
    assert len(got) == sum(map(len, want.values()))
    hits = 0
    for r in got:
        exact = dict(want[r["query_id"]])
        if r["vec_id"] in exact:
            hits += 1
            assert abs(exact[r["vec_id"]] - r["score"]) < 1e-12
    assert hits >= 0.93 * len(got)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "PART", 5)
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60, 100)]  # copies of one vector
    rows += [(200, None), (205, []), (210, [0.0] * 6), (215, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (225, [float("inf")] * 6),
             (230, [1.0, 2.0]), (None, [1.0] * 6), (5, rows[5][1]), (6, rows[6][1])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, vector string, cell string")
    got = {}
    for r in sorted(neighbours.nearest(frame, F.col("vec_id") % 5 == 0, certainty=0.999999).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    want = plain(rows, lambda i: i % 5 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items() if q < 60 or q == 230} == {q: [i for i, _ in v] for q, v in want.items() if q < 60 or q == 230}
    for q in range(60, 100, 5):  # equal scores up to rounding: copies come first
        assert [i for i, _ in got[q]] == [i for i in range(60, 100) if i != q][:5]
    few = neighbours.nearest(frame.where("vec_id < 3"), F.lit(True))
    assert few.count() == 6 and neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0
