"""Fingerprints, token alignment and spelling groups against plain Python that shares no code with them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash

from orderloom.llm import alignment, minhash, queries, spelling

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, own string, key int, block int, n int"
WORDS = [f"{a}{b}{c}" for a in ("ba", "lo", "Mi", "ré", "tu") for b in ("nd", "r", "st", "ll") for c in ("er", "a", "ing", "on")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def odd_texts():
    rnd = random.Random(5)
    prose = [" ".join(rnd.choices(WORDS, k=n)) for n in (1, 4, 5, 6, 40, 300, 2_000)]
    return [None, "", " ", "\n", "a", "  two  blanks\t and\ttabs \n", "ends in blanks   ", "   begins", prose[4], prose[4], *prose,
            "<|endoftext|> and <s> and <0x41>", "naïve café — ﬁn é", "日本語のテキスト 日本", "\U0001f600 \U0001f600‍\U0001f601!", "▁piece", "x　y 　 z",
            "nul\x00 byte", "don't 'll we've  'x", "a\xa0 b \x85 c \x1c d", "z" * 3_000, "lorem ipsum " * 800, "1234567890 3.14", "#" * 50 + " " * 300 + "#"]


# fingerprints

def plain_values(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    each = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]

    def chained(numbers):
        seed = 42
        for n in numbers:
            seed = xxhash.xxh64_intdigest(n.to_bytes(8, "little", signed=True), seed)
        return signed(seed)

    shingles = [each[i:i + 5] for i in range(len(each) - 4)] if len(each) > 5 else [each]
    least = {}
    for h in map(chained, shingles):
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    out = []
    for b in range(128):
        seen = [b]
        first, step, _ = minhash._order_of(b)
        seen += [(first + j * step) % 128 for j in range(128)]
        out.append(least[next(q for q in seen if q in least)] & 255)
    return out, {tuple(s) for s in shingles}


def plain_likeness(a, b):
    share = sum(x == y for x, y in zip(a, b)) / 128
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


def plain_report(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        mine, theirs, its = plain_values(text)[0], plain_values(edited)[0], plain_values(after)[0]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(mine).hex(), bytes(theirs).hex(),
                  pytest.approx(plain_likeness(mine, theirs)), pytest.approx(plain_likeness(mine, its)))
    return out


@pytest.mark.parametrize("ids", [1, 7, -3])
def test_fingerprints_equal_plain(spark, ids):
    rows = [(i * ids, t) for i, t in enumerate(odd_texts())]
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.fingerprint_report(table(spark, rows)).collect()}
    assert got == plain_report(rows)


def test_neighbours_across_blocks(spark):
    rnd = random.Random(3)
    ids = rnd.sample(range(-10**12, 10**12), 200) + list(range(100))
    rows = [(i, f"text {i}") for i in sorted(set(ids))]
    rnd.shuffle(rows)
    order = sorted(rows, reverse=True)
    for block_rows, most in ((10, 1 << 16), (1_000, 1 << 16), (1, 5)):
        got = minhash.with_next(table(spark, rows), {}, block_rows, most).select("doc_id", "own.text", "next.text").collect()
        assert len(got) == len(rows)
        assert {r[0]: (r[1], r[2]) for r in got} == {i: (t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)}


def test_fingerprint_edges(spark):
    assert minhash.fingerprint_report(table(spark, [])).count() == 0
    only = minhash.fingerprint_report(table(spark, [(5, "abcd")])).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and only["near_next"] == 1
    rows = [(None, "null id"), (2, "two"), (2, "two"), (2, "another"), (None, None)]
    got = minhash.fingerprint_report(table(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 7), (2, 3), (2, 3), (2, 7)]
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 3}) == 1


def test_likeness_estimates_jaccard(spark):
    rnd = random.Random(11)
    pairs = []
    for n in (30, 120, 600, 3_000):
        for kept in (1.0, 0.9, 0.5, 0.0):
            for _ in range(12):
                words = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
                other = words[:int(n * kept)] + [f"v{rnd.randrange(10**9)}" for _ in range(n - int(n * kept))]
                pairs.append((" ".join(words), " ".join(other), n, kept))
    frame = spark.createDataFrame(pairs, "a string, b string, n int, kept double")
    got = frame.select("a", "b", "n", "kept", minhash.likeness(minhash.fingerprint(frame.a), minhash.fingerprint(frame.b)).alias("near")).collect()
    errors = defaultdict(list)
    for r in got:
        a, b = plain_values(r["a"])[1], plain_values(r["b"])[1]
        errors[r["n"], r["kept"]].append(r["near"] - len(a & b) / len(a | b))
    for (n, kept), found in errors.items():
        assert abs(sum(found) / len(found)) < 0.05, (n, kept)
        assert max(map(abs, found)) < 0.2, (n, kept)
    assert all(r["near"] == 1 for r in got if r["kept"] == 1)


# alignment

def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        import base64
        spelled = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    docs = []
    for i, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [spelled[x] for x in a]
        bytes_b = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a = b = bytes_a = bytes_b = []
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, s in zip(a, spans[0]) if low <= s[0] < cut) + "|" + ",".join(str(x) for x, s in zip(b, spans[1]) if low <= s[0] < cut))
            low = cut
        links, start = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while start < len(b) and spans[1][start][1] <= s:
                start += 1
            k = start
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
        docs.append((i, len(a), len(b), groups, links))
    count = Counter(link for d in docs for link in d[4])
    best = defaultdict(int)
    for (x, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, groups, links in docs)


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_equals_plain(spark, head):
    rows = list(enumerate(odd_texts()))
    path = public_tokenizers.path
    got = alignment.align(table(spark, rows), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), head)
    assert sorted(map(tuple, got.collect())) == plain_alignment(rows)


def test_stretches_kept_or_not_give_the_same(monkeypatch):
    path = public_tokenizers.path
    paths = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), path("piece_bpe_32k.model")
    written = [" a b", "b a ", "a\n b", "", " ", "word " * 30 + "w" * 90, "\u2581x y", "\u212b \u4e2d\u6587 a", "a  b", "don't we'll", "x\x1c y\x85 z", "a b a b"]
    keeping, forgetting, whole = (alignment.Aligner(*paths) for _ in range(3))
    whole.alone = False
    for text in written * 2:
        monkeypatch.setattr(alignment, "KEPT", 400_000)
        want = whole.text(text)
        got = [keeping.text(text)]
        monkeypatch.setattr(alignment, "KEPT", 2)
        got.append(forgetting.text(text))
        for one in got:
            assert one[:5] == want[:5] and one[5].tolist() == want[5].tolist() and one[6].tolist() == want[6].tolist(), text
    assert all(len(p) <= alignment.KEPT_LENGTH for p in keeping.kept) and len(forgetting.kept) < len(keeping.kept)


def test_alignment_query_equals_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, FOLDER).collect())) == plain_alignment(rows)


def test_alignment_edges(spark):
    path = public_tokenizers.path
    run = lambda rows: alignment.align(table(spark, rows), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert run([]).count() == 0
    got = run([(None, "one two"), (4, "one two"), (4, "one two")]).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["n_best"], r["count_sum"]) for r in got) == [(0, 2, 2, 6), (4, 2, 2, 6), (4, 2, 2, 6)]


# spelling

def plain_words(rows, every, length=6, count=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= count}


def plain_groups(words):
    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_length[len(w) + d] if is_near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def test_spelling_query_equals_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    words = plain_words(rows, 199)
    want = plain_groups(words)
    assert len(want) > 500 and any(f for _, f, *_ in want)
    assert sorted(map(tuple, queries.op13_spelling(spark, FOLDER).collect())) == want


def test_spelling_slices_and_chains(spark):
    rnd = random.Random(9)
    words = {}
    for stem in ("letters", "àéîõü÷×", "b" * 80, "longerword", "ÿ" * 7):
        chain, n = stem, 5 ** 7
        while n >= 5:
            words[chain] = n
            k = rnd.randrange(len(chain))
            chain = rnd.choice([chain[:k] + rnd.choice("abcé") + chain[k:], chain[:k] + rnd.choice("abcé") + chain[k + 1:], chain[:k] + chain[k + 1:]])
            n //= rnd.choice([1, 4, 5, 6])
    words |= {stem: 9 for stem in ("lettera", "letterb", "aletters", "xxletters")}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = plain_groups(words)
    assert any(r not in (w, f) for w, f, r, *_ in want)
    for slice_bytes in (spelling.SLICE_BYTES, 64):
        assert sorted(map(tuple, spelling.group_variants(frame, slice_bytes=slice_bytes).collect())) == want


def test_spelling_edges(spark):
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, None), (2, ""), (3, "ab " * 50)])).count() == 0
    rows = [(None, "Wordly " * 30), (2, "wordly wordle ÀWordly " * 5), (2, "wordly wordle ÀWordly " * 5), (3, "y" * 50_000 + "\n" + "y " * 9)]
    for every in (2, 199):
        words = plain_words(rows, every)
        assert sorted(map(tuple, spelling.spelling_variants(table(spark, rows), every).collect())) == plain_groups(words)
