"""Near-duplicates by SimHash: fingerprints meet in the middle on the variants that each of them emits.

Two fingerprints within the radius share a variant within half the radius of both, and all that share such a variant
lie within the radius of each other. So a bucket of a variant is linked throughout: its smallest and largest component
say whether it joins anything, no pairs are written and no bucket is collected. The full ball of half the radius has
2 081 variants of 64 bits, so only fingerprints that can have several partners emit it: one half of such a pair's bits
differs in half the radius at most, the halves meet by the same rule on 33 variants each, and pairs that meet alone
there are verified and done.

Edge cases: null and empty texts, and texts of white space, have the fingerprint zero and are linked like any other;
fewer words than a shingle give one shingle; very long texts are hashed whole, in chunks; repeated rows share a
component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, cut_lineage, packed, sift, texts

WORDS, SEED, RADIUS = 4, 42, 4
CHUNK = 1 << 16
#: Up to this many crowded buckets are sent to the tasks, as so many bits; more are joined.
CROWDED, BITS = 1 << 17, 1 << 25


def fingerprint_of(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles as a signed number: a bit is set if it is in over half of the shingles' hashes."""
    parts = text.encode().lower().split()  # on bytes these touch A-Z and ASCII white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return int(np.uint64(xxhash.xxh64_intdigest(line, seed)).astype(np.int64))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = (starts + sizes)[words - 1:].tolist()
    starts = starts[:len(ends)].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), CHUNK):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<i8")[0])


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp of every row."""

    def run(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in text], dtype="int64")

    return texts(docs).select("doc_id", _tie(F.col("text")).alias("tie"), F.pandas_udf(run, "bigint")("text").alias("fp"))


def _masks(bits: int, radius: int) -> list[int]:
    out = [0]
    for n in range(1, radius + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _ball(bits: int, radius: int) -> Column:
    return F.explode(F.array(*[F.lit(m) for m in _masks(bits, radius)]))


def _halves() -> Column:
    return F.explode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32)))).alias("half")


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _link_to_ends(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of fingerprints to the smallest and largest that have the same half, where those are within the radius.

    Two rows a fingerprint: a dense group falls into few components before anything emits variants.
    """
    half = prints.select("fp", _halves())
    ends = half.groupBy("half").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    met = half.join(ends, "half").select("fp", F.explode(F.array("low", "high")).alias("b"))
    return met.where((F.col("fp") != F.col("b")) & _near("fp", "b", radius)).select(F.col("fp").alias("a"), "b")


def _meet_on_halves(roots: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of roots of pairs that met alone, and fingerprints fp that met in company of other roots and so may have further links.

    One half of the bits of a pair within the radius differs in half the radius at most, so the pair meets on a variant
    of that half. Where just two met, their smallest and largest are the pair, and its distance is known. Where all that
    met have one root, nothing is left to link.
    """
    meet = roots.select("fp", "root", _halves()).select("fp", "root", "half", _ball(32, -(-(radius // 2) // 2)).alias("m")).select(
        "fp", "root", F.col("half").bitwiseXOR(F.col("m")).alias("key"))
    buckets = meet.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"),
                                      F.min("root").alias("a"), F.max("root").alias("b")).where("n > 1 AND a < b")
    buckets = cut_lineage(buckets.where((F.col("n") > 2) | _near("low", "high", radius)), "simhash-buckets")
    links = buckets.where("n = 2").select("a", "b").distinct()
    more = cut_lineage(buckets.where("n > 2").select("key"), "simhash-crowded")
    if more.count() <= CROWDED:
        return links, cut_lineage(roots.where(_may_meet(more, radius, roots["fp"])).select("fp"), "simhash-company")
    return links, cut_lineage(
        sift(meet.select("fp", "key"), more, "key", 1 << 18).join(more, "key", "left_semi").select("fp").distinct(), "simhash-company")


def _fold(key: Column) -> Column:
    return key.bitwiseXOR(F.shiftrightunsigned(key, 17)).bitwiseAND(F.lit(BITS - 1))


def _may_meet(keys: DataFrame, radius: int, fp: Column) -> Column:
    """Condition on a fingerprint: a variant of one of its halves is among the keys, seldom else. One row a fingerprint, no variant becomes a row."""
    bits = np.zeros(BITS // 8, np.uint8)
    at = np.array([r[0] for r in keys.select(_fold(F.col("key"))).distinct().collect()], np.int64)
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    sent = keys.sparkSession.sparkContext.broadcast(bits)
    masks = _masks(32, -(-(radius // 2) // 2))

    def run(prints: pd.Series) -> pd.Series:
        whole = prints.to_numpy(np.int64).view(np.uint64)
        out = np.zeros(len(whole), bool)
        for half in (whole >> np.uint64(32), whole & np.uint64(0xFFFFFFFF) | np.uint64(1 << 32)):
            for m in masks:
                key = half ^ np.uint64(m)
                place = ((key ^ key >> np.uint64(17)) & np.uint64(BITS - 1)).astype(np.int64)
                out |= sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
        return pd.Series(out)

    return F.pandas_udf(run, "boolean")(fp)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (fp, root) after links (a, b) between roots."""
    merged = components(links.select("a", "b"), "simhash")
    return cut_lineage(roots.join(merged, roots["root"] == merged["node"], "left").select("fp", F.coalesce(merged["root"], roots["root"]).alias("root")), "simhash-roots")


def fingerprint_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for distinct fingerprints fp; root is the smallest fp reachable.

    Fingerprints are first linked to the ends of those that share a half, then pairs that met alone on a variant of a half.
    The others emit their balls, first of a quarter of the radius, then of half: a bucket whose smallest and largest
    component differ gives a link. Where more than two met, a third component may hide, so those buckets alone are looked
    at again until each holds one component.
    """
    roots = _joined(prints.select("fp", F.col("fp").alias("root")), _link_to_ends(prints, radius))
    links, company = _meet_on_halves(roots, radius)
    roots = _joined(roots, links)
    many = company.count()
    for reach in range(1, radius // 2 + 1):
        open_keys = None
        while True:
            tasks = max(1, many * len(_masks(64, reach)) // 500_000)  # one emits about half a million rows
            balls = company.join(roots, "fp").repartition(tasks, "fp").select("root", "fp", _ball(64, reach).alias("m")).select("root", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
            if open_keys is not None:
                balls = sift(balls, open_keys, "key", 1 << 18).join(open_keys, "key", "left_semi")
            found = cut_lineage(balls.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b"), "simhash-balls")
            if found.isEmpty():
                break
            roots = _joined(roots, found.select("a", "b").distinct())
            open_keys = found.where("n > 2").select("key")
            if open_keys.isEmpty():
                break
    return roots


def _rooted(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, tie (a hash of the text) and fp of every row; and the root of every fp with the smallest doc_id that has it."""
    marked = cut_lineage(fingerprints(docs), "simhash-prints")
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    return marked, prints.join(fingerprint_components(prints.select("fp"), radius), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most radius bits reach."""
    marked, known = _rooted(docs, radius)
    known = cut_lineage(known, "simhash-known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = known.join(least, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Whole rows, one of each component: the one of smallest doc_id, a null one last, then of smallest hash of its text.

    Rows without doc_id and different texts that share one take part by their own fingerprints; of repeated rows one stays.
    """
    marked, known = _rooted(docs, radius)
    firsts = marked.join(known.select("fp", "root"), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")).select("first.doc_id", "first.tie")
    rows = docs.select(packed(docs), F.col("doc_id").alias("__id"), _tie(F.col("text")).alias("__tie"))
    stay = rows.join(firsts, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__tie") == F.col("tie")), "left_semi")
    return stay.dropDuplicates(["__id", "__tie"]).select("row.*")
