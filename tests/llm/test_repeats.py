import hashlib
import random
from collections import Counter

import pytest

from orderloom.llm import queries, repeats

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, id string, h string, data string, starts string, g string"


def plain(docs, length=200):
    """docs: (doc_id, text) rows."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter()
    for _, data in texts:
        seen.update(data[p:p + length] for p in range(len(data) - length + 1))
    out = []
    for doc_id, data in texts:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen[data[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in frame.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in queries.read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert rows(queries.op7_suffix_repeats(spark, FOLDER)) == plain(docs)


@pytest.mark.parametrize("group", [2, 4_000])
def test_edges(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "LINES", 20)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh éß中", k=n))
    passage = word(700)
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "ab" * 400, word(3_000), passage, passage[:230], passage[300:]]
    texts += [word(150) + passage[a:b] + word(140) for a, b in [(0, 700), (10, 690), (3, 400), (250, 700), (100, 320)] for _ in range(3)]
    near = list(passage)
    for at in range(90, 700, 170):
        near[at] = "#"
    texts += ["".join(near), "".join(near) + passage[:300]]
    docs = [*enumerate(texts), (3, word(260)), (99, "z" * 20 + passage), (99, "z" * 20 + passage), (None, passage[50:500]), (None, None)]
    frame = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in docs], SCHEMA)
    assert rows(repeats.remove_repeats(frame, group=group)) == plain(docs)
    assert repeats.remove_repeats(frame.limit(0)).count() == 0


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghij ", k=6_000))
    monkeypatch.setattr(repeats, "CHUNK", 1 << 11)
    docs = [(0, text), (1, "q" * 777 + text[1_000:5_000]), (2, text[2_500:2_800])]
    first, starts, anchor, _ = repeats.runs_of(text.encode())
    assert starts.sum() == len(text) - 199 and first[0] == 0 and (first[1:] == (first + starts)[:-1]).all()
    assert ((anchor - starts + 1 >= 0) & (anchor + 64 <= 200)).all()
    whole = repeats.runs_of
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(repeats.remove_repeats(frame)) == plain(docs)
    assert whole is repeats.runs_of


def test_loser_tree_merges_and_counts_shared_bytes():
    rng = random.Random(1)
    for trial in range(50):
        lines = [(bytes(rng.choices(b"ab", k=rng.randint(0, 12))), b"", i, i) for i in range(rng.randint(1, 60))]
        k = rng.randint(1, 9)
        out = list(repeats.LoserTree([repeats.front_code(sorted(lines[i::k])) for i in range(k)]))
        assert [x[1] for x in out] == sorted(x[0] for x in lines), trial
        assert all(b[0] == repeats.shared(a[1], b[1]) for a, b in zip(out, out[1:]))
