import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderloom.llm import packing, queries, simhash

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, fp string, root string, piece string, block string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", "b") for i, t in enumerate(texts)], SCHEMA)


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, radius=4):
    """prints: (doc_id, fingerprint) pairs."""
    ids = [i for i, _ in prints]
    values = np.array([f for _, f in prints], np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            parent[root(int(j))] = root(i)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: least[root(i)] for i in range(len(ids))}


def test_simhash_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    want = plain_components(prints)
    got = queries.op5_simhash(spark, FOLDER).collect()
    assert len(got) == len(docs)
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == {(i, f"{f:016x}") for i, f in prints}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_dense_groups_equal_brute_force(spark):
    rnd = np.random.default_rng(4)
    flip = lambda f, n: f ^ sum(1 << int(b) for b in rnd.choice(64, n, replace=False))
    prints = {int(rnd.integers(1 << 63)) for _ in range(300)}
    for centre in [int(rnd.integers(1 << 63)) for _ in range(3)]:
        prints |= {flip(centre, int(rnd.integers(0, 4))) for _ in range(250)}
        for _ in range(40):  # a chain that leaves the group
            centre = flip(centre, int(rnd.integers(3, 6)))
            prints.add(centre)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.fingerprint_components(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    want = plain_components(list(zip(signed, prints)))
    assert {r["fp"]: r["root"] for r in got} == want and len(set(want.values())) > 300


def test_one_of_each_keeps_other_texts(spark):
    rows = [(None, "first text without an id"), (None, "another one that has no id either"), (7, "seven is the number"), (7, "of two texts with this id"),
            (9, "nine"), (9, "nine"), (8, "nine"), (None, "nine"), (None, "lonely words here"), (None, "lonely words here")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, tie int, root int")
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted(
        [(0, rows[0][1]), (0, rows[1][1]), (7, rows[2][1]), (7, rows[3][1]), (8, "nine"), (0, "lonely words here")])


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    texts = [None, "", " \t\n", "One", "one", "one two three four", "ONE two\tthree  four", "Été K", long, long, "one two three"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["fp"] % (1 << 64) == plain_fingerprint(t), i
    assert [got[i]["component_id"] for i in (0, 1, 2, 4, 6, 9)] == [0, 0, 0, 3, 5, 8]
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0
    twice = frame(spark, ["a b", "a b"]).unionByName(frame(spark, ["a b"]))
    assert simhash.near_duplicates(twice).where("component_id = 0").count() == 3
    kept = simhash.one_of_each(twice)
    assert [r["doc_id"] for r in kept.collect()] == [0] and kept.columns == twice.columns


@pytest.mark.parametrize("seed", [0, 1])
def test_chains_and_dense_groups_of_fingerprints(spark, seed):
    rng = np.random.default_rng(seed)
    values = set(map(int, rng.integers(0, 1 << 63, 60)))
    for centre in list(values)[:6]:  # chains of steps of up to four bits, and balls
        at = centre
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(b)
            values.add(at)
        for _ in range(40):
            v = centre
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    prints = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    roots = {r["fp"]: r["root"] for r in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()}
    want = plain_components(list(zip(signed, prints)))
    assert {v: roots.get(v, v) for v in signed} == want


def plain_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: b[0])
            best[0] -= n
        else:
            bins.append([size - n])
    return sorted(b[0] for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_bulk_placement_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    lengths = rng.integers(1, size + 1, int(rng.integers(1, 400))).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, seen = {}, {n: [] for n in counts}
    for length, first, many, at, offset in packing.placement(counts, size):
        seen[length] += range(first, first + many)
        for b in range(at, at + many):
            fill.setdefault(b, []).append((offset, length))
    assert all(sorted(v) == list(range(counts[n])) for n, v in seen.items())
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(size - sum(n for _, n in p) for p in fill.values()) == plain_best_fit(lengths, size)


def check_packing(rows, docs, size=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        want += [(doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    assert len(places) == len(plain_best_fit([w[3] for w in want], size))


def test_packing_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    check_packing(queries.op10_packing(spark, FOLDER).collect(), docs)


def test_packing_edges(spark):
    texts = [None, "", "a", "<|endoftext|> and 中文 \U0001F600", "word " * 9_000, "x" * 30_000, " " * 20_000 + "x", "a", "\r\n\t "]
    docs = frame(spark, texts)
    names = [public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("json", "tiktoken")]
    for ranks in (names[1], None):
        check_packing(packing.pack(docs, names[0], ranks).collect(), list(enumerate(texts)))
    assert packing.pack(docs.limit(0), *names).count() == 0
    twice = docs.unionByName(docs)
    check_packing(packing.pack(twice, *names).collect(), list(enumerate(texts)) * 2)
    ids = packing.pack(docs, *names, with_ids=True).where(F.size("ids") != F.col("length"))
    assert ids.count() == 0


def test_crowded_buckets_as_bits_lose_no_fingerprint(spark, monkeypatch):
    from orderloom.llm import simhash

    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for c in centres for _ in range(25)}
    roots = spark.createDataFrame([((p ^ 1 << 63) - (1 << 63),) for p in prints], "fp long").selectExpr("fp", "fp AS root")
    asked = []
    real = simhash._may_meet
    monkeypatch.setattr(simhash, "_may_meet", lambda *a: asked.append(1) or real(*a))
    _, by_bits = simhash._meet_on_halves(roots, 4)
    monkeypatch.setattr(simhash, "CROWDED", -1)
    _, by_join = simhash._meet_on_halves(roots, 4)
    wanted = {r.fp for r in by_join.collect()}
    assert len(asked) == 1 and wanted and wanted <= {r.fp for r in by_bits.collect()}
