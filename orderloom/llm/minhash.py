"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once. The high bits of the hash say its bin, the least hash of a bin stands for
it. An empty bin takes the value of the first bin that is not empty in an order of all bins that is its own (optimal
densification: two empty bins seldom take from the same one, and equal sets always fill alike). Of each bin the low bits
are stored, packed into whole numbers; the share of bins that agree by chance is taken off the likeness.

Words are runs without ASCII white space, as they stand; equal sequences of words have equal fingerprints.

Edge cases: texts of fewer than five words are one shingle, null and empty texts and white space the shingle of no
words; very long texts are hashed whole; documents with the same doc_id follow each other by a hash of their texts, null
doc_ids stand last; repeated rows are equal neighbours; a single document is its own next; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_sample, texts

WORDS, BINS, BITS = 5, 128, 8
_PACKED = 64 // BITS
#: Bins that an empty bin tries one by one before it looks at all that are not empty.
_TRIED = 8
#: Documents in a block of neighbours, about; blocks at most, as their borders are sent with the plan; sampled rows for a border.
BLOCK_ROWS, MAX_BLOCKS, FOR_A_BORDER = 1_000, 1 << 16, 16


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _order_of(b: int) -> tuple[int, int, int]:
    """First bin and step of bin b's order (a step that is odd meets every bin), and the step's inverse."""
    h = xxhash.xxh64_intdigest(b.to_bytes(2, "little"), seed=BINS)
    step = (h >> 32) % BINS | 1
    return h % BINS, step, pow(step, -1, BINS)


_SHIFT = BINS.bit_length() - 1


def _bin(h: Column) -> Column:
    """0 to BINS - 1, rising with the signed hash."""
    return (F.shiftright(h, 64 - _SHIFT) + BINS // 2).cast("int")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """XXH64 of each run of `words` words; of all words where there are fewer."""
    found = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[h[i + k] for k in range(words)]))
        return F.when(F.size(h) > words, many).otherwise(F.array(F.xxhash64(h)))

    return _bound(F.transform(found, lambda w: F.xxhash64(w)), shingles)


def _minima(hashes: Column) -> Column:
    """Least hash of each bin that is not empty, in the order of the bins."""
    return _bound(F.sort_array(hashes), lambda s: F.filter(
        s, lambda h, i: F.when(i == 0, F.lit(True)).otherwise(_bin(h) != _bin(s[i - 1]))))


def _orders() -> Column:
    """For every bin, the first bins of its order that it tries and what the order is made of."""
    rows = [{"tried": [(first + j * step) % BINS for j in range(_TRIED)], "first": first, "inverse": inverse}
            for first, step, inverse in map(_order_of, range(BINS))]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<tried:array<int>,first:int,inverse:int>>")


def _packed_bins(least: Column) -> Column:
    """Packed low bits of all bins, from the least hashes of those that are not empty."""
    low = (1 << BITS) - 1
    bins = F.transform(least, _bin)
    marked = F.transform(least, lambda h: F.shiftleft(_bin(h), BITS).bitwiseOR(h.bitwiseAND(low).cast("int")))

    def filled(x: Column) -> Column:
        def borrowed(b: Column) -> Column:
            def value(order: Column) -> Column:
                turns = F.transform(x["marked"], lambda v: F.shiftleft(((F.shiftright(v, BITS) - order["first"]) * order["inverse"]).bitwiseAND(BINS - 1), BITS)
                                    .bitwiseOR(v.bitwiseAND(low)))
                return F.shiftleft(b, BITS).bitwiseOR(F.coalesce(*[x["of_bin"][order["tried"][j]] for j in range(_TRIED)], F.array_min(turns).bitwiseAND(low)))

            return _bound(_orders()[b], value)

        empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), x["bins"])
        return F.sort_array(F.concat(x["marked"], F.transform(empty, borrowed)))

    def packed(all_bins: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(BINS), F.lit(_PACKED)), lambda at: F.aggregate(
            F.slice(all_bins, at, _PACKED), F.lit(0).cast("bigint"), lambda bits, v: F.shiftleft(bits, BITS).bitwiseOR(v.bitwiseAND(low).cast("bigint"))))

    known = F.struct(bins.alias("bins"), marked.alias("marked"),
                     F.map_from_arrays(bins, F.transform(least, lambda h: h.bitwiseAND(low).cast("int"))).alias("of_bin"))
    return _bound(_bound(known, filled), packed)


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """Packed fingerprint, array<bigint>, of a text that is not null."""
    return _bound(_minima(shingle_hashes(text, words)), _packed_bins)


def hexadecimal(packed: Column) -> Column:
    """The stored bits as one string."""
    return F.lower(F.array_join(F.transform(packed, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of bins whose stored bits agree, less what agrees by chance."""
    ones = _signed(sum(1 << k for k in range(0, 64, BITS)))

    def differing(w: Column) -> Column:
        spread = w
        for k in range(1, BITS):
            spread = spread.bitwiseOR(F.shiftrightunsigned(w, k))
        return F.bit_count(spread.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, w: n + differing(w))
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (1 - differ / BINS - chance) / (1 - chance))


def _block(key: Column, borders: list[dict]) -> Column:
    """How many borders, which are sorted, are not above the key: a search by halves."""
    sorted_borders = F.from_json(F.lit(json.dumps(borders)), "array<struct<id:bigint,tie:bigint>>")
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: at + F.when(
        at + step > len(borders), 0).when(sorted_borders[at + step - 1] <= key, step).otherwise(0))


def with_next(docs: DataFrame, values: dict[str, Column], block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """doc_id, `own` and `next`: structs of text and the values of each document and of the one after it.

    Documents are ordered by descending doc_id, and the first follows the last. They are dealt into blocks between borders
    of a bounded sample, and each block's highest document is also sent, as a guest, to the block before it in that order.
    """
    least_id = F.lit(-(1 << 63)).cast("bigint")
    rows = texts(docs).select("doc_id", "text", F.struct(F.coalesce(F.col("doc_id").cast("bigint"), least_id).alias("id"), F.xxhash64("text").alias("tie")).alias("key"))
    keys = rows.select("key.id", "key.tie")
    blocks = min(max_blocks, keys.count() // block_rows)
    sample = sorted(map(tuple, bounded_sample(keys, blocks * FOR_A_BORDER, "id", "tie").collect())) if blocks else []
    rows = rows.withColumn("block", _block(F.col("key"), [{"id": i, "tie": t} for i, t in sample[::FOR_A_BORDER]]))
    tops = [(r["block"], r["top"]) for r in rows.groupBy("block").agg(F.max("key").alias("top")).orderBy("block").collect()]
    guests = docs.sparkSession.createDataFrame(
        [(tuple(top), tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)], "key struct<id:bigint,tie:bigint>, host int")
    own = F.struct("text", *[v.alias(k) for k, v in values.items()])
    dealt = rows.join(F.broadcast(guests), "key", "left").select("doc_id", "key", "block", "host", own.alias("own"))
    places = F.when(F.col("host").isNull(), F.array(F.struct(F.col("block"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("block"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("block"), F.lit(True).alias("guest"))))
    dealt = dealt.select("doc_id", "key", "own", F.explode(places).alias("place")).select("doc_id", "key", "own", "place.*")
    order = Window.partitionBy("block").orderBy("guest", F.desc("key"))
    return dealt.withColumn("next", F.lead("own").over(order)).where(~F.col("guest")).select("doc_id", "own", "next")


def fingerprint_report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    The edited text ends, instead of in its last half, in the beginning of the next document, as long or all of it.
    """
    rows = with_next(docs, {"print": fingerprint(F.col("text"), words)})
    size = F.char_length("own.text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("own.text", 1, (size - half).cast("int")), F.substring("next.text", 1, half))
    rows = rows.select("doc_id", size.cast("bigint").alias("n_chars"), "own.print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), words).alias("edited_print"))
    return rows.select("doc_id", "n_chars", "edited_sha256", hexadecimal(F.col("print")).alias("fingerprint"), hexadecimal(F.col("edited_print")).alias("edited_fingerprint"),
                       likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
