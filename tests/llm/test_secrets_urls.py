import hashlib
import random
import re

import duckdb
import pytest

from orderloom.llm import queries, secrets, url_rules

FOLDER = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SCHEMA = "doc_id bigint, text string, base string, spans string, __text string"


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def check(rows, docs):
    got = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["base_sha256"]))
    want = sorted(((i, plain(t)) for i, t in docs), key=lambda x: (x[0] is None, x[0], hashlib.sha256(",".join(x[1]).encode()).hexdigest()))
    assert len(got) == len(want)
    for r, (i, spans) in zip(got, want):
        assert r["doc_id"] == i and r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, spans, r["spans"])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in spans) for k in secrets.KINDS]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == spans


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in queries.read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    check(queries.op1_secrets(spark, FOLDER).collect(), docs)


def test_edges_of_base_forms(spark):
    many = " ".join(f"token=abcdef{i}" for i in range(700)) + " é\U0001F600 " + "0123456789abcdef" * 3
    texts = [None, "", "passwd=token:abcdefgh", "SECRET = 'a.b/c+d'", "api_key:\"abcdef\"", "apikey=abcde", "password==abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15,
             "xAKIAAKIA" + "0" * 16, "f" * 23, "f" * 24, "\U0001F600 " + "a1" * 20, many, "token=" + "ab12" * 10, "toKen=abcdefgh", "ſecret=abcdefgh"]
    docs = [*enumerate(texts), (3, texts[3]), (None, texts[2])]
    frame = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA)
    check(secrets.secret_report(frame).collect(), docs)
    assert secrets.secret_report(frame.limit(0)).count() == 0
    kept = secrets.without_secrets(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in docs if not plain(t)}


def test_battery_finds_random_tokens_only(spark):
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(b64, k=n)) for n in (48, 64, 88, 120, 200)]
    words = ["thinkingaboutthesedonaudampfschifffahrtsgesellschaften", "internationalizationandlocalizationofsoftware_is_a_long_identifier",
             "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz", "a" * 90, "ab" * 60, "The-quick-brown-fox-jumps-over-the-lazy-dog-and-runs-away", "=" * 50, "-" * 80, "1234567890" * 7]
    docs = [(i, f"text {k} end") for i, k in enumerate(keys + words)]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, k in enumerate(keys):
        assert got[i] == f"random:5:{5 + len(k)}"
    assert all("random" not in got[i] for i in range(len(keys), len(docs)))


def test_lone_keys_among_many_names(spark):
    rng = random.Random(20)
    b64, b32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    keys = ["".join(rng.choices(b64, k=n)) for n in (32, 34, 36, 38, 40) for _ in range(8)]
    stems = "order match store report window stream daily alert session name product quantity unit region branch ledger partner the of and new".split()

    def slug():
        words = rng.choices(stems, k=8)
        if rng.random() < 0.3:
            words.insert(rng.randrange(8), str(rng.randint(1, 2030)))
        return rng.choice(["-".join(words), "_".join(words), "/".join(words), "".join(w.title() for w in words), "_".join(words).upper(),
                           words[0] + "".join(w.title() for w in words[1:]), "-".join(w.title() for w in words)])

    uuids = ["-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)) for _ in range(40)]
    names = [slug() for _ in range(2000)] + uuids + ["".join(rng.choices("0123456789", k=30)) for _ in range(20)]
    docs = [(i, f"text {k} end") for i, k in enumerate(keys + names + ["".join(rng.choices(b32, k=40)) for _ in range(10)])]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    found = [i for i, k in enumerate(keys) if got[i] == f"random:5:{5 + len(k)}"]
    assert len(found) >= 0.9 * len(keys)
    assert [docs[i][1] for i in range(len(keys), len(keys) + len(names)) if "random" in got[i]] == []


def test_url_query_equals_its_sql(spark):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    want = sorted(base.execute(queries.ORACLES["op2_url_rules"]).fetchall())
    got = sorted(tuple(r) for r in queries.op2_url_rules(spark, FOLDER).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want


RULES = [("com", "/", "allow"), ("a.com", "/x/y", "block"), ("a.com", "/x/", "allow"), ("b.a.com", "", "block"), ("", "/ads/", "block"), ("a.com", "/x/y", "allow"), ("c.org", "/long/path/here/", "allow"), ("d.c.org", "/l", "block")]
URLS = [None, "", "a.com/x", "http://a.com", "https://A.COM/x/yz?q", "https://z.b.a.com/", "http://b.a.com/x/y/z#f", "http://x.net/ads/1", "ftp://a.com/ads/://b", "http://c.org/long/path/here/1",
        "http://e.d.c.org/long/path/here/1", "://", "http:///p", "http://nota.com/x/y", "http://É.com/É", "http://a.com/x/" + "y" * 50_000]


def plain_rule(host, path):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or not h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


@pytest.mark.parametrize("limit", [3, 100])
def test_urls_by_trie_and_by_join(spark, limit):
    frame = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "p")], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(frame, rules, max_trie_rules=limit).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        cut = re.search("://([^/?#]*)([^?#]*)", URLS[r["page_id"]] or "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in cut[1]) if cut else ""
        assert (r["host"], r["path"]) == (host, cut[2] if cut else "")
        assert (r["rule"], r["verdict"]) == plain_rule(r["host"], r["path"]), r
    assert url_rules.judge_urls(frame.limit(0), rules).count() == 0
