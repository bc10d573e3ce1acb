"""Resolve submitted store names to store rows through a cascade of layers.

requests: request_id, store_name, phone, address, contact_person, company (strings, '' where unknown).
stores: store_code, store_name, owner_code, phone, address, contact_person, warehouse.
owners: customer_id, customer_name, status.
Every layer returns request_id, store_code, match_type, similarity, need_confirm, n_candidates.
Work is done on distinct texts; requests come back in by equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import similarity as sim
from ..functions import text as tx
from ..session import cut_lineage
from .blocking import containment_join, nearest_by_ratio, salted_join, similar_pairs
from .ranking import top_k

# Scores by which the crossed keywords look for the best store of a name
CROSS_STEPS = (0.97, 0.9, 0.8, 0.6)
# Stores that a name's rarest 2-grams may lead to; where they are more, a further 2-gram joins them
STORES_PER_KEY = 500
# Requests and stores of one name that meet in a task: each pair is a row of the result
ROWS_PER_CELL = 2_000
HIT = ["request_id", "store_code", "match_type", "similarity", "need_confirm", "n_candidates"]


def _hit(df: DataFrame, match_type: Column | str, similarity: Column | float = 1.0,
         need_confirm: Column | bool = False, n: Column | int = 1) -> DataFrame:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    return df.select("request_id", "store_code", col(match_type).alias("match_type"), col(similarity).cast("double").alias("similarity"),
                     col(need_confirm).alias("need_confirm"), col(n).cast("bigint").alias("n_candidates"))


def _best(scored: DataFrame, score: str = "score") -> DataFrame:
    """Highest score per request, then the smallest store code; combined before the shuffle."""
    top = scored.groupBy("request_id").agg(F.min(F.struct((-F.col(score)).alias("neg"), "store_code")).alias("_b"))
    return top.select("request_id", (-F.col("_b.neg")).alias(score), F.col("_b.store_code").alias("store_code"))


def store_scan(stores: DataFrame, code: str | None = None, owner: str | None = None, phone: str | None = None, name: str | None = None,
               name_part: str | None = None) -> DataFrame:
    """Stores by code, owner, phone, whole name or a part of it; what is not given does not filter."""
    out = stores
    for column, value in (("store_code", code), ("owner_code", owner), ("phone", phone), ("store_name", name)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if name_part is not None:
        out = out.where(F.col("store_name").contains(name_part))
    return out.select("store_code", "store_name", "owner_code", "phone", "warehouse")


def owner_scan(owners: DataFrame, name_part: str | None = None, customer_id: str | None = None) -> DataFrame:
    """Active owners by id or a part of the name."""
    out = owners.where("status = 'ACTIVE'")
    if customer_id is not None:
        out = out.where(F.col("customer_id") == customer_id)
    if name_part is not None:
        out = out.where(F.col("customer_name").contains(name_part))
    return out.select("customer_id", "customer_name")


def warehouse_scan(warehouses: DataFrame, name: str | None = None) -> DataFrame:
    """Warehouses that have a code, all or the one of a name."""
    out = warehouses.where("warehouse_code <> ''")
    return (out if name is None else out.where(F.col("warehouse_name") == name)).select("warehouse_name", "warehouse_code")


# --- phone ------------------------------------------------------------------------------

def phone_candidates(requests: DataFrame, stores: DataFrame, brand_prefixes: Sequence[str] = (), floor: float = 0.5) -> DataFrame:
    """Stores with the request's phone whose name is similar (sim >= floor), with the number of stores of that phone.

    sim is the name ratio, or where it is below .6 the larger of it and the ratio without brand prefix. Names meet
    within the phone through a prefix filter, so a phone shared by very many stores does not pair all of them.
    """
    asked = requests.where("phone <> '' and store_name <> ''").select("phone", F.col("store_name").alias("a")).distinct()
    known = stores.where("phone <> ''").select("phone", F.col("store_name").alias("b"), "store_code")
    counts = known.groupBy("phone").agg(F.count(F.lit(1)).alias("n_phone"))
    pairs = similar_pairs(asked, known, ["phone"], "a", "b", floor)
    if brand_prefixes:
        bare = similar_pairs(
            asked.withColumn("x", tx.strip_first_prefix("a", brand_prefixes, True)),
            known.withColumn("y", tx.strip_first_prefix("b", brand_prefixes, True)), ["phone"], "x", "y", floor)
        pairs = pairs.unionByName(
            bare.join(asked.withColumn("x", tx.strip_first_prefix("a", brand_prefixes, True)), ["phone", "x"])
            .join(known.select("phone", "b").distinct().withColumn("y", tx.strip_first_prefix("b", brand_prefixes, True)), ["phone", "y"])
            .select("phone", "a", "b")).distinct()
    pairs = cut_lineage(pairs, "phone-pairs")
    scored = sim.with_ratio(pairs, "a", "b", floor, "sim")
    if brand_prefixes:
        stripped = pairs.withColumn("x", tx.strip_first_prefix("a", brand_prefixes, True)).withColumn(
            "y", tx.strip_first_prefix("b", brand_prefixes, True))
        bare_scores = sim.with_ratio(stripped, "x", "y", floor, "sim2").drop("x", "y")
        s1, s2 = F.coalesce("sim", F.lit(0.0)), F.coalesce("sim2", F.lit(0.0))
        scored = scored.join(bare_scores, ["phone", "a", "b"], "full_outer").select(
            "phone", "a", "b", F.when(s1 < 0.6, F.greatest(s1, s2)).otherwise(s1).alias("sim"))
    named = scored.where(F.col("sim") >= floor).join(known, ["phone", "b"]).join(counts, "phone")
    return requests.select("request_id", "phone", F.col("store_name").alias("a")).join(named, ["phone", "a"]).select(
        "request_id", "store_code", F.col("sim").alias("similarity"), "n_phone")


def _phone_names(requests: DataFrame, stores: DataFrame, accept: float, least: float, floor: float = 0.5) -> DataFrame:
    """(phone, a, store_code, s, n_phone, n): a submitted name's best store of its phone, best first, if it is at least `least` like it.

    n is the number of stores at `floor` or more, counted for names below `accept` at phones of several stores: only these
    report it, so a phone of very many stores does not compare every name with all of them.
    """
    known = cut_lineage(stores.where("phone <> ''").groupBy("phone", F.col("store_name").alias("b")).agg(
        F.min("store_code").alias("store_code"), F.count(F.lit(1)).alias("n_b")), "phone-names")
    counts = known.groupBy("phone").agg(F.sum("n_b").alias("n_phone"))
    asked = requests.where("phone <> '' and store_name <> ''").select("phone", F.col("store_name").alias("a"))
    near = nearest_by_ratio(asked, known, ["phone"], "a", "b", (0.95, 0.9, accept, least), lowest=None)
    best = near.join(known, ["phone", "b"]).groupBy("phone", "a").agg(F.max("score").alias("s"), F.min("store_code").alias("store_code"))
    best = cut_lineage(best.join(counts, "phone"), "phone-best")
    weak = best.where((F.col("s") < accept) & (F.col("n_phone") > 1)).select("phone", "a")
    if weak.isEmpty():
        return best.withColumn("n", F.lit(1).cast("bigint"))
    pairs = cut_lineage(similar_pairs(weak, known, ["phone"], "a", "b", floor), "phone-pairs")
    alike = sim.with_ratio(pairs, "a", "b", floor, "sim").where(F.col("sim") >= floor)
    n = alike.join(known, ["phone", "b"]).groupBy("phone", "a").agg(F.sum("n_b").alias("n"))
    return best.join(n, ["phone", "a"], "left")


def by_phone(requests: DataFrame, stores: DataFrame, brand_prefixes: Sequence[str] = ()) -> DataFrame:
    """sim >= .8 accepts, >= .6 asks for confirmation, else the phone is not trusted."""
    if brand_prefixes:
        found = phone_candidates(requests, stores, brand_prefixes)
        best = found.groupBy("request_id").agg(
            F.min(F.struct((-F.col("similarity")).alias("neg"), "store_code")).alias("_b"),
            F.max("n_phone").alias("n_phone"), F.count(F.lit(1)).alias("n"))
        best = best.select("request_id", F.col("_b.store_code").alias("store_code"), (-F.col("_b.neg")).alias("s"), "n_phone", "n").where("s >= 0.6")
    else:
        names = _phone_names(requests, stores, 0.8, 0.6)
        best = requests.select("request_id", "phone", F.col("store_name").alias("a")).join(names, ["phone", "a"])
    kind = F.when(F.col("s") >= 0.8, "phone_exact_high_conf").when(F.col("n_phone") > 1, "phone_exact_multi").otherwise("phone_exact")
    return _hit(best, kind, F.col("s"), F.col("s") < 0.8, F.when((F.col("s") < 0.8) & (F.col("n_phone") > 1), F.col("n")).otherwise(1))


# --- names --------------------------------------------------------------------------------

def by_exact_name(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """One store of that name is a match; several need confirmation."""
    named = stores.groupBy("store_name").agg(F.count(F.lit(1)).alias("n"), F.min("store_code").alias("store_code"))
    hits = requests.where("store_name <> ''").join(named, "store_name")
    return _hit(hits, "exact", 1.0, F.col("n") > 1, F.col("n"))


def by_contained_name(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores whose name contains the submitted name: the shortest name, then the smallest code."""
    pairs = containment_join(requests.select(F.col("store_name").alias("needle")), stores.select(F.col("store_name").alias("hay")))
    best = pairs.groupBy("needle").agg(F.min(F.struct(F.length("hay").alias("n"), F.col("hay").alias("hay"))).alias("_b"))
    shortest = best.select(F.col("needle").alias("_needle"), F.col("_b.n").alias("_n"))
    equally_short = pairs.join(shortest, (F.col("needle") == F.col("_needle")) & (F.length("hay") == F.col("_n")))
    codes = equally_short.join(stores.select(F.col("store_name").alias("hay"), "store_code"), "hay").groupBy("needle").agg(
        F.min("store_code").alias("store_code"))
    return _hit(requests.join(codes.withColumnRenamed("needle", "store_name"), "store_name"), "fuzzy_contains")


def _similar_texts(requests: DataFrame, stores: DataFrame, suggest: float) -> DataFrame:
    """(a, b, score): distinct submitted names with the store names that are at least `suggest` like them."""
    pairs = similar_pairs(requests.where("store_name <> ''").select(F.col("store_name").alias("a")), stores.select(F.col("store_name").alias("b")), [], "a", "b", suggest)
    return sim.with_ratio(cut_lineage(pairs, "similar-pairs"), "a", "b", suggest, "score").where(F.col("score") >= suggest)


def similar_candidates(requests: DataFrame, stores: DataFrame, suggest: float = 0.5) -> DataFrame:
    """(request_id, store_code, store_name, score): every store whose name is at least `suggest` like the submitted one."""
    scored = cut_lineage(_similar_texts(requests, stores, suggest), "similar-scored")
    near = requests.select("request_id", F.col("store_name").alias("a")).join(scored, "a")
    met = salted_join(near, stores.select(F.col("store_name").alias("b"), "store_code"), ["b"], F.struct("request_id", "a"), ROWS_PER_CELL)
    return met.select("request_id", "store_code", F.col("b").alias("store_name"), "score")


def similar_names(requests: DataFrame, stores: DataFrame, accept: float = 0.75, suggest: float = 0.5, k: int | None = None) -> DataFrame:
    """Extension, off by default: best similar name (>= accept), else its candidates (>= suggest) to choose from.

    The candidates themselves come from `similar_candidates`; here they are chosen and counted by distinct names, so a
    name of many stores that many requests submit costs a row a name. k bounds how many are counted, as a report of k would show.
    """
    names = stores.groupBy(F.col("store_name").alias("b")).agg(F.min(F.struct("store_code")).alias("code"), F.count(F.lit(1)).alias("n"))
    best, count = F.min(F.struct((-F.col("score")).alias("neg"), "code")).alias("_b"), F.sum("n").alias("n")
    scored = cut_lineage(_similar_texts(requests, stores, suggest).join(names, "b").groupBy("a").agg(best, count), "similar-names")
    per = requests.select("request_id", F.col("store_name").alias("a")).where("request_id is not null").join(scored, "a").groupBy("request_id").agg(F.min("_b").alias("_b"), F.sum("n").alias("n"))
    per = per.select("request_id", F.col("_b.code.store_code").alias("store_code"), (-F.col("_b.neg")).alias("score"), F.col("n") if k is None else F.least("n", F.lit(k)).alias("n"))
    strong = F.col("score") >= accept
    return _hit(per, F.when(strong, "fuzzy_similar").otherwise("fuzzy"), F.col("score"), ~strong, F.when(strong, 1).otherwise(F.col("n")))


# --- company, contact, address ----------------------------------------------------------------

def owners_containing(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """(text, customer_id, customer_name) of the active owners whose name contains the text."""
    active = owners.where("status = 'ACTIVE'")
    pairs = containment_join(texts.select(F.col("text").alias("needle")), active.select(F.col("customer_name").alias("hay")))
    return pairs.select(F.col("needle").alias("text"), F.col("hay").alias("customer_name")).join(active, "customer_name").select(
        "text", "customer_id", "customer_name")


def by_company(requests: DataFrame, stores: DataFrame, owners: DataFrame) -> DataFrame:
    """First active owner by name whose name contains the company; its first store by code."""
    found = owners_containing(requests.where("company <> ''").select(F.col("company").alias("text")), owners)
    first = found.groupBy("text").agg(F.min(F.struct("customer_name", "customer_id")).alias("_o")).select(
        F.col("text").alias("company"), F.col("_o.customer_id").alias("owner_code"))
    home = stores.groupBy("owner_code").agg(F.min("store_code").alias("store_code"))
    return _hit(requests.select("request_id", "company").join(first, "company").join(home, "owner_code"), "customer_company")


def by_contact(requests: DataFrame, stores: DataFrame, floor: float = 0.6) -> DataFrame:
    """Store name contains the contact name and is at least `floor` like it."""
    pairs = containment_join(requests.select(F.col("contact_person").alias("needle")), stores.select(F.col("store_name").alias("hay")))
    ratio = sim.plain_ratio(F.col("needle"), F.col("hay"))
    scored = pairs.withColumn("score", ratio).where(F.col("score") >= floor).join(
        stores.select(F.col("store_name").alias("hay"), "store_code"), "hay").select(F.col("needle").alias("request_id"), "store_code", "score")
    best = _best(scored).withColumnRenamed("request_id", "contact_person")
    return _hit(requests.select("request_id", "contact_person").join(best, "contact_person"), "contact_person", F.col("score"))


def by_address(requests: DataFrame, stores: DataFrame, preferred: Sequence[str] = (), char_class: str = tx.CJK) -> DataFrame:
    """Longest address word any store name contains; among these stores a preferred brand, else the closest address."""
    addresses = requests.where("address <> ''").select("address").distinct()
    words = addresses.select("address", F.posexplode(tx.address_words("address", char_class)).alias("pos", "word"))
    pairs = containment_join(words.select(F.col("word").alias("needle")), stores.select(F.col("store_name").alias("hay")))
    first = words.join(pairs.select(F.col("needle").alias("word")).distinct(), "word", "left_semi").groupBy("address").agg(
        F.min_by("word", "pos").alias("word"))
    liked = F.lit(False)
    for brand in preferred:
        liked = liked | F.col("hay").contains(brand)
    hits = pairs.select(F.col("needle").alias("word"), "hay").join(
        stores.select(F.col("store_name").alias("hay"), F.col("address").alias("store_address"), "store_code"), "hay")
    # one row per word and store address: stores at one address are alike here
    hits = cut_lineage(hits.groupBy("word", "store_address").agg(
        F.min("store_code").alias("store_code"), F.min(F.when(liked, F.col("store_code"))).alias("liked_code")), "address-hits")
    first = cut_lineage(first, "address-words")

    # a preferred brand needs no score, an equal address has the highest one; then by similarity in falling steps
    words_liked = hits.groupBy("word").agg(F.min("liked_code").alias("liked_code"), F.min("store_code").alias("any_code"))
    done = first.join(words_liked.where("liked_code is not null"), "word").select("address", F.col("liked_code").alias("store_code"), F.lit(0.0).alias("score"))
    open_words = first.join(words_liked.where("liked_code is null"), "word").select("address", "word", "any_code")
    equal = open_words.join(hits.withColumnRenamed("store_address", "address"), ["word", "address"]).select(
        "address", "store_code", F.lit(1.0).alias("score"))
    done = done.unionByName(equal)
    rest = cut_lineage(open_words.join(equal, "address", "left_anti"), "address-rest")
    near = nearest_by_ratio(rest.select("word", "address"), hits.select("word", "store_address"), ["word"], "address", "store_address")
    best = near.join(hits, ["word", "store_address"]).groupBy("address").agg(F.min("store_code").alias("store_code"), F.max("score").alias("score"))
    best = rest.join(best, "address", "left").select("address", F.coalesce("store_code", "any_code").alias("store_code"), F.coalesce("score", F.lit(0.0)).alias("score"))
    done = done.unionByName(best)
    return _hit(requests.select("request_id", "address").join(done, "address"), "address_keyword", F.col("score"))


# --- crossed keywords -----------------------------------------------------------------------------

def coverage_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, floor: float, char_class: str) -> DataFrame:
    """Pairs within equal keys in which b may have at least `floor` of the 2-grams of a; none is lost (prefix filter)."""
    grams_b = right.select(*keys, b, F.explode(tx.class_bigrams(b, char_class)).alias("_g"))
    freq = grams_b.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_df"))
    grams_a = left.select(*keys, a, F.explode(tx.class_bigrams(a, char_class)).alias("_g")).join(freq, [*keys, "_g"], "left")
    ranked = grams_a.groupBy(*keys, a).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("f"), F.col("_g").alias("g")))).alias("_s"))
    need = F.greatest(F.ceil(F.size("_s") * F.lit(floor) - 1e-9), F.lit(1))
    prefix = ranked.select(*keys, a, F.explode(F.slice("_s", F.lit(1), (F.size("_s") - need + 1).cast("int"))["g"]).alias("_g"))
    return salted_join(grams_b, prefix, [*keys, "_g"], F.col(b)).select(*keys, a, b).distinct()


def cross_keywords(requests: DataFrame, brand_words: Sequence[str] = (), skip: Sequence[str] = (), top: int = 3,
                   char_class: str = tx.CJK) -> DataFrame:
    """(store_name, word): the first place words of a submitted name after the brand words are taken out."""
    rest = F.col("store_name")
    for w in brand_words:
        rest = F.replace(rest, F.lit(w), F.lit(""))
    words = F.regexp_extract_all(rest, F.lit(f"([{char_class}]{{2,4}})"), F.lit(1))
    if skip:
        words = F.filter(words, lambda w: ~w.isin(*skip))
    names = requests.where("store_name <> ''").select("store_name").distinct()
    return names.select("store_name", F.explode(F.array_distinct(F.slice(words, 1, top))).alias("word"))


def covering_pairs(left: DataFrame, right: DataFrame, a: str, b: str, char_class: str, most: int = STORES_PER_KEY) -> DataFrame:
    """(a, b) where b has all 2-grams of a, for every a whose 2-grams lead to `most` texts b or fewer; the others give no pair.

    Texts meet on the rarest 2-gram of a; where more texts than that have it, on it and the second rarest, and so on. The
    right side gives those keys only that are asked for. Bits of the 2-grams rule out most pairs where they meet, the
    numbers of the 2-grams decide the others, so neither bits nor hashed keys need be free of collisions.
    """
    def with_grams(df: DataFrame, c: str) -> DataFrame:
        return df.select(c, F.explode(tx.class_bigrams(c, char_class)).alias("_g"))

    # 2-grams by rising number of texts b: keys are made of them in this order on both sides
    right = cut_lineage(right.select(b).distinct(), "covering-texts")
    freq = cut_lineage(with_grams(right, b).groupBy("_g").agg(F.count(F.lit(1)).alias("_df")).withColumn("_id", F.monotonically_increasing_id()), "covering-grams")

    def ranked(df: DataFrame, c: str) -> DataFrame:
        known = with_grams(df, c).join(freq, "_g", "left")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64("_id"), F.lit(64)).cast("int"))
        out = known.groupBy(c).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("f"), F.col("_id").alias("h")))).alias("_s"), F.bit_or(bit).alias("_bits"))
        return out.where(F.col("_s")[0]["f"] > 0).select(c, F.col("_s.h").alias("_h"), F.col("_s")[0]["f"].alias("_n"), "_bits")

    none = F.lit(0).cast("bigint")
    asked = ranked(left, a).select(a, "_h", "_bits", F.xxhash64(none, F.col("_h")[0]).alias("_key"), F.lit(1).alias("_at"), "_n")
    asked = cut_lineage(asked, "covering-asked")
    offered = ranked(right, b).select(b, "_h", F.col("_bits").alias("_has"), F.posexplode("_h").alias("_i", "_last")).select(
        b, "_h", "_has", F.xxhash64(none, "_last").alias("_key"), (F.col("_i") + 1).alias("_at"))
    found = None
    while True:
        offered = cut_lineage(offered.join(asked.select("_key").distinct(), "_key", "left_semi"), "covering-offered")
        if found is not None:  # the first key's number is its 2-gram's, which is known
            asked = cut_lineage(asked.join(offered.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "_key"), "covering-asked")
        met = asked.where(F.col("_n") <= most).select(a, "_bits", F.col("_h").alias("_all"), "_key").join(offered.select(b, "_has", "_h", "_key"), "_key")
        covered = (F.col("_bits").bitwiseAND(F.bitwise_not("_has")) == 0) & (F.size(F.array_except("_all", "_h")) == 0)
        pairs = cut_lineage(met.where(covered).select(a, b), "covering-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        asked = asked.where((F.col("_n") > most) & (F.size("_h") > F.col("_at")))
        if asked.isEmpty():
            return found
        offered = offered.join(asked.select("_key").distinct(), "_key", "left_semi").where(F.size("_h") > F.col("_at")).select(
            b, "_h", "_has", "_key", F.posexplode(F.slice("_h", F.col("_at") + 1, F.size("_h") - F.col("_at"))).alias("_i", "_last"), "_at").select(
            b, "_h", "_has", F.xxhash64("_key", "_last").alias("_key"), (F.col("_at") + F.col("_i") + 1).alias("_at"))
        asked = asked.select(a, "_h", "_bits", F.xxhash64("_key", F.get("_h", F.col("_at"))).alias("_key"), (F.col("_at") + 1).alias("_at"))


def _whole_cover(words: DataFrame, names: DataFrame, codes: DataFrame, char_class: str) -> DataFrame:
    """(request_id, store_code, score) of the names whose best store is one that has all their 2-grams, beyond doubt.

    A store that lacks one of n 2-grams scores (n - 1) / 2n at most and half the ratio, in which only characters count that
    any store has. Who scores more than that needs no other store compared.
    """
    a, b = F.col("a"), F.col("b")
    asked = cut_lineage(words.groupBy("a").agg(F.collect_set("word").alias("_words")), "whole-names")
    pairs = covering_pairs(asked, names, "a", "b", char_class, STORES_PER_KEY)
    named = pairs.join(asked, "a").where(F.exists("_words", lambda w: b.contains(w))).select("a", "b")
    pairs = cut_lineage(named.withColumn("_exact", sim.contained_ratio(a, b)), "whole-pairs")
    sure = pairs.groupBy("a").agg(F.coalesce(F.max("_exact"), F.lit(0.0)).alias("_sure"))
    open_pairs = pairs.join(sure, "a").where(F.coalesce("_exact", sim.length_bound(a, b)) >= F.col("_sure") - 1e-9)
    scored = open_pairs.withColumn("score", F.lit(0.5) + F.coalesce("_exact", sim.seq_ratio(F.when(F.col("_exact").isNull(), a), b)) * 0.5)
    best = cut_lineage(_best(scored.join(codes, "b").select(a.alias("request_id"), "store_code", "score")), "whole-best")
    chars = names.select(F.explode(F.split("b", "")).alias("_c")).distinct().agg(F.array_join(F.collect_list("_c"), "").alias("_chars"))
    judged = best.crossJoin(chars).crossJoin(names.agg(F.min(F.length("b")).alias("_least")))
    size, known = F.length("request_id"), F.length("request_id") - F.length(F.expr("translate(request_id, _chars, '')"))
    n = F.size(tx.class_bigrams("request_id", char_class))
    others = F.lit(0.5) * (n - 1) / n + known / (size + F.greatest(known, F.col("_least")))
    return judged.where(F.col("score") > others + 1e-9).select("request_id", "score", "store_code")


def by_cross_keywords(requests: DataFrame, stores: DataFrame, brand_words: Sequence[str] = (), skip: Sequence[str] = (),
                      floor: float = 0.35, char_class: str = tx.CJK) -> DataFrame:
    """Any store with one of the words; half 2-gram coverage, half ratio, at least `floor`.

    Names whose best store has all their 2-grams are found by these (`_whole_cover`). The others best first: at each step all pairs that reach its score are found, so a name with one is done, and only the others go
    on to the next. A score of s needs a ratio of 2s - 1; where that says little, a coverage or a ratio of s.
    """
    words = cut_lineage(cross_keywords(requests, brand_words, skip, char_class=char_class).withColumnRenamed("store_name", "a"), "cross-words")
    codes = cut_lineage(stores.groupBy(F.col("store_name").alias("b")).agg(F.min("store_code").alias("store_code")).where("b is not null"), "cross-codes")
    done = cut_lineage(_whole_cover(words, codes.select("b"), codes, char_class).where(F.col("score") >= floor), "cross-whole")
    words = cut_lineage(words.join(done.select(F.col("request_id").alias("a")), "a", "left_anti"), "cross-rest")
    inside = containment_join(words.select(F.col("word").alias("needle")), codes.select(F.col("b").alias("hay")))
    right = cut_lineage(inside.select(F.col("needle").alias("word"), F.col("hay").alias("b")), "cross-stores")
    left = cut_lineage(words.select("word", "a").join(right.select("word").distinct(), "word", "left_semi"), "cross-names")
    a, b = F.col("a"), F.col("b")
    most = F.col("_cover") * 0.5 + sim.length_bound(a, b) * 0.5
    for least in (*(s for s in CROSS_STEPS if s > floor), floor):
        if left.isEmpty():
            break
        right = cut_lineage(right.join(left.select("word").distinct(), "word", "left_semi"), "cross-stores")
        if least >= 0.75:
            pairs = similar_pairs(left, right, ["word"], "a", "b", 2 * least - 1 - 1e-9)
        else:
            pairs = coverage_pairs(left, right, ["word"], "a", "b", least, char_class).unionByName(
                similar_pairs(left, right, ["word"], "a", "b", least))
        near = pairs.select("a", "b").distinct().withColumn("_cover", tx.bigram_coverage(a, b, char_class)).where(most >= least - 1e-9)
        scored = cut_lineage(near, "cross-pairs").withColumn("_ratio", sim.plain_ratio(a, b)).withColumn(
            "score", F.col("_cover") * 0.5 + F.col("_ratio") * 0.5).where(F.col("score") >= least)
        best = cut_lineage(_best(scored.join(codes, "b").select(a.alias("request_id"), "store_code", "score")), "cross-best")
        done = done.unionByName(best)
        left = cut_lineage(left.join(best.select(F.col("request_id").alias("a")), "a", "left_anti"), "cross-names")
    best = done.withColumnRenamed("request_id", "store_name")
    return _hit(requests.select("request_id", "store_name").join(best, "store_name"), "keyword_cross", F.col("score"))


def by_contact_phone(requests: DataFrame, stores: DataFrame, suggest: float = 0.5) -> DataFrame:
    """Fallback with a contact name: the phone's only store, or its most similar one (to confirm below .8)."""
    asked = requests.where("length(contact_person) >= 2 and contact_person <> store_name and phone <> ''")
    known = stores.where("phone <> ''").groupBy("phone").agg(F.count(F.lit(1)).alias("n_phone"), F.min("store_code").alias("only"))
    base = asked.join(known, "phone")
    single = _hit(base.where("n_phone = 1").withColumnRenamed("only", "store_code"), "phone_exact")
    many = base.where("n_phone > 1").select("request_id", "phone", F.col("store_name").alias("a"), "n_phone", "only")
    b = stores.select("phone", F.col("store_name").alias("b"), "store_code")
    asked = cut_lineage(many.where("a <> ''").select("phone", "a").distinct(), "fallback-names")
    # a name with a store at .8 needs no more; the others count their candidates
    sure = nearest_by_ratio(asked, b, ["phone"], "a", "b", (0.95, 0.9, 0.8), lowest=None)
    open_names = cut_lineage(asked.join(sure.select("phone", "a").distinct(), ["phone", "a"], "left_anti"), "fallback-open")
    near = cut_lineage(sim.with_ratio(similar_pairs(open_names, b, ["phone"], "a", "b", suggest), "a", "b", suggest, "score").where(F.col("score") >= suggest), "fallback-pairs")
    # names with no candidate take the nearest name of the phone; those that share no character leave the smallest code
    others = open_names.join(near.select("phone", "a").distinct(), ["phone", "a"], "left_anti")
    far = nearest_by_ratio(others, b, ["phone"], "a", "b", (0.25, 0.125, 0.0625))
    scored = cut_lineage(sure.unionByName(near.select("phone", "a", "b", "score")).unionByName(far), "fallback-scored")
    scored = many.join(scored, ["phone", "a"]).join(b, ["phone", "b"]).select("request_id", "store_code", "score")
    per = scored.groupBy("request_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "store_code")).alias("_b"),
                                           F.count_if(F.col("score") >= suggest).alias("n"))
    best = many.select("request_id", "only").join(per, "request_id", "left").select(
        "request_id", F.coalesce("_b.store_code", "only").alias("store_code"), F.coalesce(-F.col("_b.neg"), F.lit(0.0)).alias("s"), "n")
    strong = F.col("s") >= 0.8
    multi = _hit(best, F.when(strong, "phone_exact_high_conf").otherwise("phone_exact_multi"), F.col("s"), ~strong,
                 F.when(strong, 1).otherwise(F.coalesce("n", F.lit(0))))
    return single.unionByName(multi)


# --- brand and warehouse ------------------------------------------------------------------------------

def warehouse_part(c: Column, suffixes: Sequence[str] = fv.WAREHOUSE_SUFFIXES, reach: int = 4) -> Column:
    """struct(warehouse, brand) of 'brand + warehouse' names: up to `reach` characters before the last suffix belong to it."""
    out = None
    for s in suffixes:
        at = F.length(c) - F.instr(F.reverse(c), s[::-1]) - len(s) + 1  # characters before the last suffix
        start = F.greatest(at - reach, F.lit(0))
        found = c.contains(s) & (at > 0)
        part = F.substr(c, start + 1, at - start + len(s))
        brand = F.when(start > 0, F.left(c, start)).otherwise(F.left(c, at))
        value = F.struct(part.alias("warehouse"), brand.alias("brand"))
        out = F.when(found, value) if out is None else out.when(found, value)
    return out


def by_brand_and_warehouse(requests: DataFrame, stores: DataFrame, owners: DataFrame,
                           suffixes: Sequence[str] = fv.WAREHOUSE_SUFFIXES, reach: int = 4) -> DataFrame:
    """Warehouse part names a warehouse; the owner is an active one whose name contains the brand, else an active one
    with stores there. The first store (by code) of that owner in that warehouse matches."""
    names = requests.where("store_name <> ''").select("store_name").distinct().withColumn(
        "p", warehouse_part(F.col("store_name"), suffixes, reach)).where("p is not null").select("store_name", "p.warehouse", "p.brand")
    housed = stores.where("owner_code <> ''").groupBy("warehouse", "owner_code").agg(F.min("store_code").alias("store_code"))
    known = names.join(housed.select("warehouse").distinct(), "warehouse", "left_semi")
    by_brand = owners_containing(known.select(F.col("brand").alias("text")), owners).groupBy("text").agg(
        F.min("customer_id").alias("owner_code")).withColumnRenamed("text", "brand")
    there = housed.join(owners.where("status = 'ACTIVE'").select(F.col("customer_id").alias("owner_code")).distinct(), "owner_code", "left_semi")
    any_there = there.groupBy("warehouse").agg(F.min("owner_code").alias("other"))
    chosen = known.join(by_brand, "brand", "left").join(any_there, "warehouse", "left").withColumn(
        "owner_code", F.coalesce("owner_code", "other"))
    hits = chosen.join(housed, ["warehouse", "owner_code"]).select("store_name", "store_code")
    return _hit(requests.select("request_id", "store_name").join(hits, "store_name"), "brand_warehouse")


# --- hints, warehouse codes, cascade ----------------------------------------------------------------------

def owner_hints(requests: DataFrame, owners: DataFrame, k: int | None = None) -> DataFrame:
    """Active owners whose name contains the submitted store name, by name; k is the size of a report, None gives all."""
    found = owners_containing(requests.select(F.col("store_name").alias("text")).distinct(), owners)
    if k is not None:
        found = top_k(found, ["text"], [F.col("customer_name"), F.col("customer_id")], k)
    return requests.select("request_id", F.col("store_name").alias("text")).join(found, "text").select(
        "request_id", "customer_id", "customer_name")


def similar_owners(requests: DataFrame, owners: DataFrame, floor: float = 0.7) -> DataFrame:
    """(request_id, customer_id, customer_name, similarity): active owners whose name is at least `floor` like the submitted store name."""
    active = owners.where("status = 'ACTIVE'")
    asked = requests.where("store_name <> ''").select("request_id", F.col("store_name").alias("a"))
    pairs = similar_pairs(asked.select("a"), active.select(F.col("customer_name").alias("b")), [], "a", "b", floor)
    scored = cut_lineage(sim.with_ratio(cut_lineage(pairs, "owner-pairs"), "a", "b", floor, "similarity").where(F.col("similarity") >= floor), "owner-scored")
    met = salted_join(asked.join(scored, "a"), active.select("customer_id", "customer_name", F.col("customer_name").alias("b")), ["b"], F.struct("request_id", "a"), ROWS_PER_CELL)
    return met.select("request_id", "customer_id", "customer_name", "similarity")


def add_warehouse_code(df: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Tolerant lookup: '' where the warehouse has no code."""
    codes = warehouses.select(F.col("warehouse_name").alias("warehouse"), F.col("warehouse_code").alias("_code"))
    return df.join(codes, "warehouse", "left").withColumn("warehouse_code", F.coalesce("_code", F.lit(""))).drop("_code")


def missing_warehouse_codes(df: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Strict lookup: the rows that would stop the output."""
    known = warehouses.where("warehouse_code <> ''").select(F.col("warehouse_name").alias("warehouse"))
    return df.join(known, "warehouse", "left_anti")


def match_stores(requests: DataFrame, stores: DataFrame, owners: DataFrame, brand_prefixes: Sequence[str] = (),
                 preferred: Sequence[str] = (), char_class: str = tx.CJK, cross_class: str = tx.CJK,
                 with_similar: bool = False) -> DataFrame:
    """The cascade. Each step sees only the requests the steps before left open.

    phone · address (invalid name) · contact then address (invalid name) · company · exact · contained ·
    [similar] · crossed keywords · contact fallback (phone, address). Requests that nobody matches come last, with
    match_type 'unmatched', no store, and as candidates the owners whose name contains the submitted name (`owner_hints`).
    """
    facts = ["store_name", "phone", "address", "contact_person", "company"]
    distinct = requests.select(*facts).distinct().withColumn("request_id", F.sha2(F.concat_ws("\u0001", *facts), 256))
    work = cut_lineage(distinct, "requests")
    bad = tx.invalid_store_name("store_name")
    has_contact = F.length("contact_person") >= 2
    steps = [
        lambda r: by_phone(r, stores, brand_prefixes),
        lambda r: by_address(r.where(bad & (F.col("phone") != "")), stores, preferred, char_class),
        lambda r: by_contact(r.where(bad & (F.col("contact_person") != "")), stores),
        lambda r: by_address(r.where(bad), stores, preferred, char_class),
        lambda r: by_company(r, stores, owners),
        lambda r: by_exact_name(r, stores),
        lambda r: by_contained_name(r, stores),
    ]
    if with_similar:
        steps.append(lambda r: similar_names(r, stores))
    steps += [
        lambda r: by_cross_keywords(r, stores, char_class=cross_class),
        lambda r: by_contact_phone(r, stores),
        lambda r: by_address(r.where(has_contact & (F.col("contact_person") != F.col("store_name"))), stores, preferred, char_class),
    ]
    done = None
    for i, step in enumerate(steps):
        hits = cut_lineage(step(work), f"store-step{i}")
        done = hits if done is None else done.unionByName(hits)
        work = cut_lineage(work.join(hits.select("request_id"), "request_id", "left_anti"), f"open{i}")
        if work.isEmpty():
            break
    hints = owner_hints(work, owners).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    none = work.join(hints, "request_id", "left").withColumn("store_code", F.lit(None).cast("string"))
    done = done.unionByName(_hit(none, "unmatched", 0.0, True, F.coalesce("n", F.lit(0))))
    keyed = requests.withColumn("_key", F.sha2(F.concat_ws("\u0001", *facts), 256)).select(*requests.columns, "_key")
    return keyed.join(done.withColumnRenamed("request_id", "_key"), "_key").drop("_key")


def auto_confirmed(match_type: Column, need_confirm: Column, n_candidates: Column) -> Column:
    """Only a unique exact name match needs no person."""
    return F.coalesce((match_type == "exact") & ~need_confirm & (n_candidates <= 1), F.lit(False))


def merge_confirmations(answers: DataFrame, keys: Sequence[str] = fv.CONFIRMATION_KEYS) -> DataFrame:
    """(order_id, confirm_key, confirmed_code): the latest confirmation of each store key of an order.

    answers: order_id, seq, confirmed_stores (map of store key to code, a batch), store_code and the key columns (a single
    confirmation, which counts if it has a code or a name, and wins over the batch of the same answer).
    """
    batch = answers.select("order_id", "seq", F.lit(0).alias("single"), F.explode("confirmed_stores").alias("confirm_key", "confirmed_code"))
    single = answers.where("coalesce(store_code, '') <> '' OR coalesce(store_name, '') <> ''").select(
        "order_id", "seq", F.lit(1).alias("single"), tx.first_non_empty(*keys).alias("confirm_key"), F.col("store_code").alias("confirmed_code"))
    return batch.unionByName(single.where("coalesce(confirm_key, '') <> ''")).groupBy("order_id", "confirm_key").agg(
        F.max_by("confirmed_code", F.struct("seq", "single")).alias("confirmed_code"))


def with_confirmations(matches: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Earlier confirmations win over the match: by store key, then by key = submitted name, then by the name submitted
    with the confirmation. A confirmation of another store never applies.

    matches: order_id, store_key, store_name, store_code. confirmations: order_id, confirm_key, submitted_name, confirmed_code, seq.
    """
    latest = confirmations.groupBy("order_id", "confirm_key").agg(
        F.max_by(F.struct("confirmed_code", "submitted_name"), "seq").alias("c"), F.max("seq").alias("seq"))
    keyed = latest.select("order_id", "confirm_key", "c.confirmed_code", "c.submitted_name", "seq")
    by_key = keyed.select("order_id", F.col("confirm_key").alias("store_key"), F.col("confirmed_code").alias("_c1"))
    by_name = keyed.select("order_id", F.col("confirm_key").alias("store_name"), F.col("confirmed_code").alias("_c2"))
    sub = keyed.where("submitted_name <> ''").groupBy("order_id", "submitted_name").agg(F.min_by("confirmed_code", "seq").alias("c"))
    sub_key = sub.select("order_id", F.col("submitted_name").alias("store_key"), F.col("c").alias("_c3"))
    sub_name = sub.select("order_id", F.col("submitted_name").alias("store_name"), F.col("c").alias("_c4"))
    joined = (
        matches.join(by_key, ["order_id", "store_key"], "left").join(by_name, ["order_id", "store_name"], "left")
        .join(sub_key, ["order_id", "store_key"], "left").join(sub_name, ["order_id", "store_name"], "left")
    )
    return joined.withColumn("confirmed_code", F.coalesce("_c1", "_c2", "_c3", "_c4")).withColumn(
        "final_code", F.coalesce("confirmed_code", "store_code")).drop("_c1", "_c2", "_c3", "_c4")


def owner_of_name(names: DataFrame, stores: DataFrame) -> DataFrame:
    """Owner of a bare store name: the store of that name, else one whose name contains it or is inside it
    (shortest distance in length, then smallest name)."""
    owner = stores.groupBy("store_name").agg(F.min("owner_code").alias("owner_code"))
    texts = names.select("name").where("name <> ''").distinct()
    exact = texts.join(owner.withColumnRenamed("store_name", "name"), "name").withColumn("source", F.lit("exact"))
    rest = texts.join(exact.select("name"), "name", "left_anti")
    all_names = owner.select("store_name")
    inside = containment_join(rest.withColumnRenamed("name", "needle"), all_names.withColumnRenamed("store_name", "hay"))
    around = containment_join(all_names.withColumnRenamed("store_name", "needle"), rest.withColumnRenamed("name", "hay"))
    pairs = inside.select(F.col("needle").alias("name"), F.col("hay").alias("store_name")).unionByName(
        around.select(F.col("hay").alias("name"), F.col("needle").alias("store_name")))
    best = pairs.groupBy("name").agg(F.min(F.struct(
        F.abs(F.length("store_name") - F.length("name")).alias("d"), F.col("store_name").alias("s"))).alias("_b"))
    near = best.select("name", F.col("_b.s").alias("store_name")).join(owner, "store_name").select(
        "name", "owner_code", F.lit("contains").alias("source"))
    return texts.join(exact.unionByName(near), "name", "left").select(
        "name", F.coalesce("owner_code", F.lit("")).alias("owner_code"), F.coalesce("source", F.lit("unresolved")).alias("source"))


def lines_to_stores(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Order lines to the order's stores by store key or by store name, as two equi-joins.

    lines: order_id, line_store, …; stores: order_id, store_key, store_name.
    """
    by_key = lines.join(stores.select("order_id", "store_key", F.col("store_key").alias("line_store")), ["order_id", "line_store"])
    by_name = lines.join(
        stores.where("store_name <> store_key").select("order_id", "store_key", F.col("store_name").alias("line_store")), ["order_id", "line_store"])
    return by_key.unionByName(by_name)


def store_corrections(matches: DataFrame) -> DataFrame:
    """Rows where the system's and the person's store codes are both present and differ."""
    return matches.where("store_code <> '' and confirmed_code <> '' and store_code <> confirmed_code")


def order_state(store_status: DataFrame, unmatched_lines: DataFrame) -> DataFrame:
    """Per order: needs_store_confirm, needs_hint, failed, needs_sku_confirm or success.

    store_status: order_id, status (confirmed, auto_confirmed, pending, need_hint, failed). unmatched_lines: order_id, n_unmatched.
    """
    per = store_status.groupBy("order_id").agg(
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "need_hint").alias("hints"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    joined = per.join(unmatched_lines, "order_id", "left")
    state = (
        F.when(F.col("pending") > 0, "needs_store_confirm").when(F.col("hints") > 0, "needs_hint")
        .when(F.col("failed") > 0, "failed").when(F.coalesce("n_unmatched", F.lit(0)) > 0, "needs_sku_confirm").otherwise("success")
    )
    return joined.select("order_id", "pending", "hints", "failed", F.coalesce("n_unmatched", F.lit(0)).cast("bigint").alias("n_unmatched"), state.alias("state"))
