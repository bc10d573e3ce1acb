"""Text clean-up, keys and small scalar parsers, all as native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

CJK = r"一-龥"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim any kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def scrub(c: Column | str, all_zero_width: bool = True) -> Column:
    """Trim, then delete tabs, non-breaking, ideographic and zero-width space, BOM and every blank."""
    hidden = r"[\t\x{a0}\x{3000}\x{200b}-\x{200f}\x{feff}]+" if all_zero_width else r"[\t\x{a0}\x{3000}\x{200b}\x{200f}\x{feff}]+"
    cleaned = F.regexp_replace(strip(F.coalesce(_col(c), F.lit(""))), hidden, "")
    return F.regexp_replace(cleaned, " ", "")


def clean_name(c: Column | str) -> Column:
    """Product name without bracketed parts and white space; separators go only at the ends."""
    out = F.regexp_replace(_col(c), r"[（(][^)）]*[)）]", "")
    out = F.regexp_replace(out, r"[\s\p{Z}]+", "")
    out = F.regexp_replace(out, r"[-_./\\,;:]+$", "")
    return F.regexp_replace(out, r"^[-_./\\,;:]+", "")


def clean_name_hard(c: Column | str) -> Column:
    """Older cleaner: trailing - / . off, widest bracket span off, keep letters, digits, _ and /."""
    out = strip(c)
    for tail in (r"-+$", r"/+$", r"\.+$"):
        out = F.regexp_replace(out, tail, "")
    out = F.regexp_replace(out, r"[（(].*[)）]", "")
    return F.regexp_replace(out, r"[^\p{L}\p{N}_/]", "")


def spec_of(c: Column | str, patterns: Sequence[str] = fv.SPEC_PATTERNS, unit_chars: str = fv.UNIT_CHARS) -> Column:
    """Specification named in a product name, or ''."""
    c = _col(c)
    found = [F.nullif(F.regexp_extract(c, f"(?i){p}", 0), F.lit("")) for p in patterns]
    bracket = F.regexp_extract(c, r"[（(]([^）)]+)[）)]", 1)
    looks_like_spec = bracket.rlike(r"\d") & bracket.rlike(f"[{unit_chars}]")
    return F.coalesce(*found, F.when(looks_like_spec, bracket), F.lit(""))


def _numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))


def _units(c: Column, unit_chars: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"([{unit_chars}])"), F.lit(1))


def spec_score(order_spec: Column, sku_spec: Column, ratio: Column, unit_chars: str = fv.UNIT_CHARS) -> Column:
    """Agreement of two specifications; `ratio` is read only where the rules do not decide."""
    a, b = F.lower(strip(order_spec)), F.lower(strip(sku_spec))
    an, bn = _numbers(a), _numbers(b)
    au, bu = _units(a, unit_chars), _units(b, unit_chars)
    have_numbers = (F.size(an) > 0) & (F.size(bn) > 0)
    no_a = order_spec.isNull() | (order_spec == "")
    no_b = sku_spec.isNull() | (sku_spec == "")
    return (
        F.when(no_a & no_b, 1.0)
        .when(no_a | no_b, 0.5)
        .when(a == b, 1.0)
        .when((F.size(au) > 0) & (F.size(bu) > 0) & (F.get(au, F.lit(0)) != F.get(bu, F.lit(0))), 0.3)
        .when(have_numbers & (an == bn) & (au == bu), 1.0)
        .when(have_numbers & (F.array_sort(F.array_distinct(an)) == F.array_sort(F.array_distinct(bn))), 0.8)
        .otherwise(ratio)
    )


def spec_needs_ratio(order_spec: Column, sku_spec: Column, unit_chars: str = fv.UNIT_CHARS) -> Column:
    """True for the pairs of specifications that only the sequence ratio can score."""
    return spec_score(order_spec, sku_spec, F.lit(-1.0), unit_chars) == -1.0


def containment_boost(order_name: Column, sku_name: Column) -> Column:
    return F.when(sku_name.contains(order_name), 0.25).when(order_name.contains(sku_name), 0.10).otherwise(0.0)


def name_core(c: Column | str) -> Column:
    """Name without leading digits and the letters that follow them."""
    return strip(F.regexp_replace(_col(c), r"^[0-9]+[a-zA-Z]*", ""))


def words_in(c: Column, words: Sequence[str]) -> Column:
    """The words of a list that occur in the text."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: c.contains(w))


def core_word_gate(
    order_name: Column, sku_name: Column,
    forms: Sequence[str] = fv.PRODUCT_FORMS, seasonings: Sequence[str] = fv.SEASONING_WORDS,
) -> Column:
    """May two product names mean the same product at all?"""
    a, b = name_core(order_name), name_core(sku_name)
    contained = sku_name.contains(order_name) | order_name.contains(sku_name)
    seasoned = F.lit(False)
    for word in seasonings:
        seasoned = seasoned | a.contains(word) | b.contains(word)
    shared_form = F.lit(False)
    for word in forms:
        shared_form = shared_form | (a.contains(word) & b.contains(word))
    return (
        F.when(contained | (a == "") | (b == ""), True)
        .when(b.contains(a) | a.contains(b), True)
        .when(seasoned, a == b)
        .otherwise(shared_form)
    )


def grams(c: Column | str, size: int, char_class: str | None = None) -> Column:
    """Distinct character n-grams, optionally only those wholly inside a character class."""
    c = _col(c)
    out = F.when(
        F.length(c) >= size,
        F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substr(c, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))
    if char_class:
        out = F.filter(out, lambda g: g.rlike(f"^[{char_class}]+$"))
    return F.array_distinct(out)


def core_grams(c: Column | str, char_class: str = CJK) -> Column:
    """Distinct 2- and 3-grams."""
    return F.array_union(grams(c, 2, char_class), grams(c, 3, char_class))


def gram_gate(a: Column, b: Column, char_class: str = CJK) -> Column:
    """Any shared 2-3-gram passes; a name too short to have one passes too; an empty name fails."""
    ga, gb = core_grams(a, char_class), core_grams(b, char_class)
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), False)
        .when((F.size(ga) == 0) | (F.size(gb) == 0), True)
        .otherwise(F.arrays_overlap(ga, gb))
    )


def gram_boost(a: Column, b: Column, char_class: str = CJK) -> Column:
    shared = F.size(F.array_intersect(core_grams(a, char_class), core_grams(b, char_class)))
    return F.least(shared * F.lit(0.1), F.lit(0.3))


def class_bigrams(c: Column | str, char_class: str = CJK) -> Column:
    """2-grams of the text after all other characters are dropped."""
    return grams(F.regexp_replace(_col(c), f"[^{char_class}]", ""), 2)


def bigram_coverage(query: Column, other: Column, char_class: str = CJK) -> Column:
    """Share of the query's 2-grams that the other text has."""
    q = class_bigrams(query, char_class)
    shared = F.size(F.array_intersect(q, class_bigrams(other, char_class)))
    return F.when(F.size(q) == 0, 0.0).otherwise(shared / F.size(q))


def strip_first_prefix(c: Column | str, prefixes: Sequence[str], trim_dash: bool = False) -> Column:
    """Take off the first listed prefix that fits, once."""
    c = _col(c)
    if not prefixes:
        return c
    out = None
    for p in prefixes:
        rest = F.substr(c, F.lit(len(p) + 1))
        if trim_dash:
            rest = strip(F.regexp_replace(rest, r"^-+", ""))
        out = F.when(c.startswith(p), rest) if out is None else out.when(c.startswith(p), rest)
    return out.otherwise(c)


def keywords(c: Column | str, top: int | None = None, char_class: str = CJK) -> Column:
    """Distinct 2-4 character segments in order of appearance."""
    found = F.regexp_extract_all(_col(c), F.lit(f"([{char_class}]{{2,4}})"), F.lit(1))
    found = F.array_distinct(found)
    return found if top is None else F.slice(found, 1, top)


def edge_keywords(c: Column | str) -> Column:
    """Prefixes and suffixes of length 5, 4, 3 and 2; only the prefix where it is the whole name."""
    c = _col(c)
    parts = []
    for n in (5, 4, 3, 2):
        parts.append(F.when(F.length(c) >= n, F.substr(c, F.lit(1), F.lit(n))))
        parts.append(F.when(F.length(c) > n, F.right(c, F.lit(n))))
    return F.array_compact(F.array(*parts))


def place_words(c: Column | str, suffixes: Sequence[str] = fv.PLACE_SUFFIXES, char_class: str = CJK) -> Column:
    """Distinct place words (2-6 characters and a place suffix)."""
    alternatives = "|".join(suffixes)
    return F.array_distinct(
        F.regexp_extract_all(_col(c), F.lit(f"([{char_class}]{{2,6}}(?:{alternatives}))"), F.lit(1)))


def address_keywords(c: Column | str, char_class: str = CJK) -> Column:
    """First county or district word, else city, else province, else the first two words."""
    words = F.regexp_extract_all(_col(c), F.lit(f"([{char_class}]{{2,4}})"), F.lit(1))

    def first_with(*marks: str) -> Column:
        hit = F.filter(words, lambda w: w.rlike("|".join(marks)))
        return F.when(F.size(hit) > 0, F.slice(hit, 1, 1))

    return F.coalesce(first_with("县", "区"), first_with("市"), first_with("省"), F.slice(words, 1, 2))


def address_words(c: Column | str, char_class: str = CJK) -> Column:
    """All words of two or more characters, longest first, earlier first among equals."""
    words = F.regexp_extract_all(_col(c), F.lit(f"([{char_class}]{{2,}})"), F.lit(1))
    ranked = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(ranked), lambda s: s["w"])


def invalid_store_name(c: Column | str, prefixes: Sequence[str] = fv.INVALID_STORE_PREFIXES) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    out = F.length(c) < 3
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def safe_int(c: Column | str) -> Column:
    """Whole number left after all other characters are dropped, else 0."""
    digits = F.regexp_replace(_col(c).cast("string"), r"[^0-9.]", "")
    return F.coalesce(F.floor(digits.try_cast("double")), F.lit(0)).cast("bigint")


def first_number(c: Column | str) -> Column:
    """First number in the text, cut to a whole number, else 0."""
    found = F.regexp_extract(_col(c).cast("string"), r"\d+(?:\.\d+)?", 0)
    return F.coalesce(F.floor(found.try_cast("double")), F.lit(0)).cast("bigint")


def first_non_empty(*cs: Column | str, default: str = "") -> Column:
    """First value that is neither null, '' nor 'nan'."""
    usable = [F.when(~_col(c).isin("", "nan"), _col(c)) for c in cs]
    return F.coalesce(*usable, F.lit(default))


def input_kind(c: Column | str) -> Column:
    """Kind of an order input, from its file suffix."""
    s = F.lower(strip(c))
    return (
        F.when(s.rlike(r"\.(xlsx|xls)$"), "excel")
        .when(s.rlike(r"\.(jpg|jpeg|png|bmp|gif|webp)$"), "image")
        .when(s.rlike(r"\.pdf$"), "pdf")
        .when(s.rlike(r"\.(docx|doc)$"), "word")
        .otherwise("text")
    )


def looks_like_code(c: Column | str) -> Column:
    return _col(c).rlike(r"^[A-Z][A-Z0-9]{2,}$")


def version_key(c: Column | str) -> Column:
    """Version without blanks and the leading v."""
    return F.regexp_replace(strip(c), r"^[vV]", "")


def rate_of(c: Column | str) -> Column:
    """'87.5%' as 0.875; anything else is 0."""
    return F.coalesce(F.regexp_replace(strip(c), r"^%+|%+$", "").try_cast("double") / 100, F.lit(0.0))


def round_half_up(c: Column, digits: int) -> Column:
    """Round with plain double arithmetic, so that other engines get the same bits."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5 + 1e-9).cast("double") / scale
