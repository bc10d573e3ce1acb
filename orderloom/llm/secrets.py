"""Secret scan: three known forms and a battery of randomness tests, in DataFrame functions only.

Base forms are the leftmost non-overlapping matches of three patterns. Other long tokens are candidates: from the
alphabet that a token keeps to its encoding is inferred (hexadecimal, base 32, base 64), and three tests ask whether
its symbols look like uniform draws: chi-squared over the alphabet, Wald-Wolfowitz runs about the middle of the
alphabet, and lag-one serial correlation. Fisher's method joins them; a token that fails stays out. For the rest the
chance that words would look as random joins two tails that shrink with length: the chi-squared statistic under the
letter concentration of prose, and the number of odd neighbours (a small letter before a capital, a letter beside a
digit) under their share in identifiers made of words. Benjamini and Hochberg's rule is applied to these chances within
bands of length.

Edge cases: null and empty texts have no spans; very long texts are scanned whole, in time in proportion to their
length; rows are never joined or grouped, so repeated rows each give their own result; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, cut_lineage, normal_cdf, packed

# The base forms, their kinds in order, and the shortest group 2 of an assignment.
KINDS = ["assign", "access", "hex"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6

#: Candidates of the battery.
TOKEN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
BLOCK = 256
#: Neighbours that words seldom make, by class of character: a small letter, A capital, 0 digit.
ODD = ["aA", "a0", "A0", "0a", "0A"]
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _placed(text: Column, pattern: str, kind: int, matches: Column, keep: Column | None) -> Column:
    """Spans of matches: running sums over (gap, match) lengths, in blocks so that time stays in proportion to their number."""
    gaps = F.split(text, pattern, -1)
    flags = keep if keep is not None else F.transform(matches, lambda m: F.lit(True))
    pairs = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(
        F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"))), flags, lambda p, k: F.struct(
            p["g"].alias("g"), p["m"].alias("m"), k.alias("k")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, e: s + e["g"] + e["m"]))
    heads = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

    def run(block: Column, head: Column) -> Column:
        zero = F.struct(head.alias("at"), F.array().cast(f"array<struct<start:bigint,kind:int,end:bigint,keep:boolean>>").alias("out"))
        return F.aggregate(block, zero, lambda a, e: F.struct(
            (a["at"] + e["g"] + e["m"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + e["g"]).alias("start"), F.lit(kind).alias("kind"),
                                                (a["at"] + e["g"] + e["m"]).alias("end"), e["k"].alias("keep")))).alias("out")),
            lambda a: a["out"])

    placed = F.flatten(F.zip_with(blocks, F.slice(heads, 1, F.size(blocks)), run))
    wanted = F.transform(F.filter(placed, lambda s: s["keep"]), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.when(F.size(matches) > 0, wanted).otherwise(F.array().cast(SPAN))


def _two_sided(z: Column) -> Column:
    return F.greatest(2 * normal_cdf(-F.abs(z)), F.lit(1e-300))


def _chi_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    spread = 2 / (9 * df)
    return F.greatest(normal_cdf((1 - spread - F.pow(x / df, F.lit(1 / 3))) / F.sqrt(spread)), F.lit(1e-300))


def battery(tokens: Column, prose_two: float = 0.066, prose_three: float = 0.0062, odd_share: float = 0.15) -> Column:
    """Array of struct(s, n, p_random, p_prose) from one of struct(s, t), t being the token.

    prose_two, prose_three: chance that two or three letters of prose are the same. odd_share: share of odd neighbours in
    tokens made of words, one word in camel case being six letters or so. Each step binds what the next one
    reads more than once, so that no expression is written out, planned or computed twice.
    """
    digits = "0123456789"
    alphabets = [digits + "abcdef", UPPER + "234567", UPPER + LOWER + digits + "+/"]
    sized = F.array(*[F.lit(a) for a in alphabets])

    def step(rows: Column, **made) -> Column:
        return F.transform(rows, lambda c: F.struct(*[f(c).alias(name) for name, f in made.items()]))

    def same(*names: str) -> dict:
        return {name: (lambda c, name=name: c[name]) for name in names}

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)

    rows = step(tokens, **same("s"), body=lambda c: F.rtrim(c["t"], F.lit("=")))
    classes = LOWER + UPPER + digits, "a" * 26 + "A" * 26 + "0" * 10
    rows = step(rows, **same("s", "body"), shape=lambda c: F.translate(c["body"], *classes), kind=lambda c: F.when(c["body"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), 1).when(c["body"].rlike("^[A-Z2-7]+$"), 2).otherwise(3))
    rows = step(rows, **same("s", "kind"), odd=lambda c: sum((F.length(c["shape"]) - F.length(F.replace(c["shape"], F.lit(t), F.lit("")))) / 2 for t in ODD), alphabet=lambda c: F.element_at(sized, c["kind"]), n=lambda c: F.length(c["body"]).cast("double"),
                text=lambda c: F.when(c["kind"] == 1, F.lower(c["body"])).otherwise(F.translate(c["body"], "-_", "+/")))
    rows = step(rows, **same("s", "n", "odd", "text", "alphabet"), k=lambda c: F.length(c["alphabet"]).cast("double"), halves=lambda c: F.coalesce(*[
        F.when(c["kind"] == i + 1, F.translate(c["text"], a, "0" * (len(a) // 2) + "1" * (len(a) // 2))) for i, a in enumerate(alphabets)]))
    rows = step(
        rows, **same("s", "n", "k", "odd"), ones=lambda c: F.length(F.replace(c["halves"], F.lit("0"), F.lit(""))).cast("double"),
        turns=lambda c: sum((F.length(c["halves"]) - F.length(F.replace(c["halves"], F.lit(t), F.lit("")))) / 2 for t in ("01", "10")),
        squares=lambda c: total(F.transform(F.sequence(F.lit(1), F.length(c["alphabet"])), lambda i: F.pow(
            (F.length(c["text"]) - F.length(F.replace(c["text"], F.substring(c["alphabet"], i, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0)))),
        symbols=lambda c: F.transform(F.filter(F.split(c["text"], ""), lambda x: x != ""), lambda x: F.instr(c["alphabet"], x).cast("double")))
    rows = step(rows, **same("s", "n", "k", "odd", "ones", "turns", "symbols"), chi=lambda c: c["k"] / c["n"] * c["squares"] - c["n"],
                mean=lambda c: total(c["symbols"]) / c["n"], twice=lambda c: 2 * c["ones"] * (c["n"] - c["ones"]))
    rows = step(
        rows, **same("s", "n", "k", "odd", "chi"), twice=lambda c: c["twice"],
        runs=lambda c: (c["turns"] - c["twice"] / c["n"]) / F.sqrt(F.greatest(c["twice"] * (c["twice"] - c["n"]) / (c["n"] * c["n"] * (c["n"] - 1)), F.lit(1e-9))),
        power=lambda c: total(F.transform(c["symbols"], lambda x: (x - c["mean"]) * (x - c["mean"]))),
        lagged=lambda c: total(F.zip_with(F.slice(c["symbols"], F.lit(1), F.size(c["symbols"]) - 1), F.slice(c["symbols"], F.lit(2), F.size(c["symbols"]) - 1),
                                          lambda x, y: (x - c["mean"]) * (y - c["mean"]))))
    rows = step(
        rows, **same("s", "n", "k", "odd", "chi"), p_chi=lambda c: _chi_tail(c["chi"], c["k"] - 1),
        p_runs=lambda c: F.when(c["twice"] == 0, F.lit(1e-300)).otherwise(_two_sided(c["runs"])),
        p_serial=lambda c: F.when(c["power"] == 0, F.lit(1e-300)).otherwise(_two_sided(c["lagged"] / c["power"] * F.sqrt(c["n"]))))
    rows = step(
        rows, **same("s", "n"), w=lambda c: (odd_share * (c["n"] - 1) - c["odd"]) / F.sqrt(odd_share * (1 - odd_share) * (c["n"] - 1)), y=lambda c: -(F.log(c["p_chi"]) + F.log(c["p_runs"]) + F.log(c["p_serial"])),
        z=lambda c: (c["chi"] - (c["k"] * ((1 - prose_two) + c["n"] * prose_two) - c["n"])) / (c["k"] / c["n"] * F.sqrt(
            4 * c["n"] * c["n"] * c["n"] * (prose_three - prose_two ** 2) + 2 * c["n"] * c["n"] * (prose_two + prose_two ** 2 - 2 * prose_three))))
    return step(rows, **same("s", "n"), p_random=lambda c: F.exp(-c["y"]) * (1 + c["y"] + c["y"] * c["y"] / 2), p_prose=lambda c: normal_cdf((c["z"] + c["w"]) / 2 ** 0.5))


def _thresholds(tokens: DataFrame, rate: float) -> dict[int, int]:
    """Per band of length the lowest step that Benjamini and Hochberg's rule accepts.

    tokens: (band, step), step being floor(-10 ln p), 400 at most, so that exp(-step / 10) is p rounded up. The counts
    are a few thousand at most however many tokens there are, and only one row a band reaches the driver.
    """
    steps = tokens.groupBy("band", "step").agg(F.count("*").alias("c"))
    return {r["band"]: r["step"] for r in (
        steps.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("step", "c"))).alias("s"), F.sum("c").alias("m"))
        .select("band", "m", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(
            F.element_at("s", i)["step"].alias("step"),
            F.aggregate(F.slice(F.col("s"), i, F.size("s")), F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("beyond")))).alias("e"))
        .where(F.exp(-F.col("e.step") / 10) <= rate * F.col("e.beyond") / F.col("m"))
        .groupBy("band").agg(F.min("e.step").alias("step"))).collect()}


def find_secrets(docs: DataFrame, false_discovery: float = 0.01, random_floor: float = 0.01, kept: list[str] | None = None) -> DataFrame:
    """row (the columns kept), base (spans of the base forms) and spans (all of them), each sorted by start and kind.

    A span is struct(start, kind, end): code points, end exclusive; kind counts along KINDS, 3 being a random token.
    One pass over the texts, whose findings are stored; then one small aggregation over the candidates.
    """
    keep, text = ["row"], F.col("__text")
    rows = docs.select(packed(docs, *(kept or ["doc_id"])), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("*", F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("__m0"), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)).alias("__m1"),
                       F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("__m2"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("__m3"))
    long_value = F.transform("__m0", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE)
    rows = rows.select(*keep, F.array_sort(F.concat(
        _placed(text, ASSIGN, 0, F.col("__m0"), long_value), _placed(text, ACCESS, 1, F.col("__m1"), None),
        _placed(text, HEX, 2, F.col("__m2"), None))).alias("base"),
        F.zip_with(_placed(text, TOKEN, 3, F.col("__m3"), None), "__m3", lambda s, t: F.struct(s.alias("s"), t.alias("t"))).alias("__tokens"))
    rows = rows.select(*keep, "base", F.filter("__tokens", lambda c: ~F.exists("base", lambda b: (b["start"] < c["s"]["end"]) & (c["s"]["start"] < b["end"]))).alias("__tokens"))
    rows = rows.select(*keep, "base", F.transform(battery(F.col("__tokens")), lambda c: F.struct(
        c["s"].alias("s"), c["p_random"].alias("p_random"), F.floor(2 * F.log2(c["n"])).cast("int").alias("band"),
        F.least(F.floor(-10 * F.log(F.greatest(c["p_prose"], F.lit(1e-300)))), F.lit(400)).cast("int").alias("step"))).alias("__tested"))
    found = cut_lineage(rows, "secrets")
    limits = _thresholds(found.select(F.explode("__tested").alias("t")).select("t.band", "t.step"), false_discovery)
    if not limits:
        return found.select(*keep, "base", F.col("base").alias("spans"))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    random = F.transform(F.filter("__tested", lambda c: (c["p_random"] >= random_floor) & (c["step"] >= F.coalesce(F.element_at(limit, c["band"]), F.lit(10_000)))),
                         lambda c: c["s"])
    return found.select(*keep, "base", F.array_sort(F.concat("base", random)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "random"]])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs).select("row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                                     F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents, whole rows, in which no span was found."""
    return find_secrets(docs, kept=docs.columns).where(F.size("spans") == 0).select("row.*")
