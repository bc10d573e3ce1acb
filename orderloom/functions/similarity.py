"""Sequence ratio (the one score Spark has no built-in for) and scores derived from it."""

from collections.abc import Sequence
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

# Pairs a task remembers before it starts afresh.
KNOWN_PAIRS = 200_000
# Up to this product of lengths places in a dictionary are faster than arrays.
SHORT = 4096


def matched_characters(a: str, b: str) -> int:
    """Characters of the longest common block, the first in a and then in b, and of the blocks found alike on either side of it."""
    if len(a) * len(b) <= SHORT:
        return _matched_short(a, b)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    total, todo = 0, [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        right = y[b0:b1]
        ends = np.zeros(len(right) + 1, np.int64)  # length of the common block that ends before each place of b
        best = end_a = end_b = 0
        for i in range(a0, a1):
            ends[1:] = (ends[:-1] + 1) * (right == x[i])
            longest = int(ends.max()) if len(right) else 0
            if longest > best:
                best, end_a, end_b = longest, i + 1, b0 + int(ends.argmax())
        if best:
            total += best
            todo += [(a0, end_a - best, b0, end_b - best), (end_a, a1, end_b, b1)]
    return total


def _matched_short(a: str, b: str) -> int:
    """The same by the places of every character of b."""
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        ends: dict[int, int] = {}  # length of the common block that ends at a place of b
        best = end_a = end_b = 0
        for i in range(a0, a1):
            now = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    n = now[j] = ends.get(j - 1, 0) + 1
                    if n > best:
                        best, end_a, end_b = n, i + 1, j + 1
            ends = now
        if best:
            total += best
            todo += [(a0, end_a - best, b0, end_b - best), (end_a, a1, end_b, b1)]
    return total


def _characters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts; number of the text, place in it and code of every character."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sizes, np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes)) - first, codes


def may_reach(x: Sequence[str], y: Sequence[str], floor: float, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of all pairs whose ratio may reach `floor`; none that reaches it is lost.

    The blocks of the ratio are a common subsequence, so both the characters two texts share (as multisets) and their
    longest common subsequence bound it. The first is one matrix product, the second runs bitwise over the pairs left.
    """
    (nx, ox, px, cx), (ny, oy, py, cy) = _characters(x), _characters(y)
    chars, code = np.unique(np.concatenate([cx, cy]), return_inverse=True)
    owner = np.concatenate([ox, oy + len(nx)])
    order = np.lexsort((code, owner))
    o, c, at = owner[order], code[order], np.arange(len(order))
    starts = np.concatenate([[True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])])
    nth = at - np.maximum.accumulate(np.where(starts, at, 0))
    token = np.unique(c * (len(at) + 1) + nth, return_inverse=True)[1]
    # two more columns take what a pair needs off its product: what is left falls short where it is negative
    has = np.zeros((len(nx) + len(ny), int(token.max()) + 3), np.float32)
    has[o, token] = 1
    has[:len(nx), -2], has[:len(nx), -1], has[len(nx):, -2], has[len(nx):, -1] = nx * (-floor / 2), 1, 1, ny * (-floor / 2)
    slack = 1e-5 * (1 + int(nx.max()) + int(ny.max()))  # far above what float32 rounds off
    i, j = np.divmod(np.flatnonzero(has[:len(nx)] @ has[len(nx):].T >= -slack), len(ny))
    least = floor / 2 * (nx[i] + ny[j]) - 1e-9

    masks = np.zeros((len(ny), len(chars) + 1), np.uint64)  # places of each character in y; the last one is padding
    low = py < 64
    np.bitwise_or.at(masks, (oy[low], code[len(cx):][low]), np.left_shift(np.uint64(1), py[low].astype(np.uint64)))
    text = np.full((len(nx), int(nx.max())), len(chars), np.int64)
    text[ox, px] = code[:len(cx)]
    keep = np.ones(len(i), bool)
    short = np.flatnonzero(ny[j] <= 64)
    for start in range(0, len(short), at_once):
        part = short[start:start + at_once]
        a, b = i[part], j[part]
        v = np.full(len(part), ~np.uint64(0))
        for step in range(int(nx[a].max())):
            u = v & masks[b, text[a, step]]
            v = (v + u) | (v - u)
        common = np.bitwise_count(~v & (~np.uint64(0) >> (64 - ny[b]).astype(np.uint64)))
        keep[part] = common >= least[part]
    return i[keep], j[keep]


def _tiles(texts: Sequence[str], rows: int, characters: int) -> list[np.ndarray]:
    """Numbers of the texts by rising length, in tiles of bounded rows and characters."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order, out, start = np.argsort(sizes, kind="stable"), [], 0
    ends = np.cumsum(sizes[order])
    while start < len(order):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + characters, "right"))
        stop = min(max(stop, start + 1), start + rows)
        out.append(order[start:stop])
        start = stop
    return out


def near_tiles(x: Sequence[str], y: Sequence[str], floor: float, rows: int = 1_000, characters: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of `may_reach`, tile by tile, so that arrays stay small whatever the number and length of the texts."""
    right = [(q, [y[k] for k in q]) for q in _tiles(y, rows, characters)]
    for p in _tiles(x, rows, characters):
        some = [x[k] for k in p]
        for q, others in right:
            # tiles go by length: the nearest two lengths of them bound the ratio of all their pairs
            short, long = (len(some[-1]), len(others[0])) if len(some[-1]) < len(others[0]) else (len(others[-1]), len(some[0]))
            if short < long and 2 * short < (floor - 1e-9) * (short + long):
                continue
            i, j = may_reach(some, others, floor)
            if len(i):
                yield p[i], q[j]


def pairs_may_reach(x: Sequence[str], y: Sequence[str], floor: float, cells: int = 1 << 21) -> np.ndarray:
    """Whether the ratio of each pair (x[k], y[k]) may reach `floor`, by their longest common subsequence; none that reaches it is lost."""
    out = np.ones(len(x), bool)
    chars, code = np.unique(np.concatenate([_characters(x)[3], _characters(y)[3]]), return_inverse=True)
    if not len(chars):
        return out
    split = sum(map(len, x))
    ends_x, ends_y = (np.concatenate([[0], np.cumsum([len(t) for t in side])]) for side in (x, y))
    at_once = max(cells // (len(chars) + 1), 1)
    for start in range(0, len(x), at_once):
        stop = min(start + at_once, len(x))
        (nx, ox, px, _), (ny, oy, py, _) = _characters(x[start:stop]), _characters(y[start:stop])
        masks = np.zeros((stop - start, len(chars) + 1), np.uint64)  # places of each character in y; the last one is padding
        low = py < 64
        of_y = code[split + ends_y[start]:split + ends_y[stop]]
        np.bitwise_or.at(masks, (oy[low], of_y[low]), np.left_shift(np.uint64(1), py[low].astype(np.uint64)))
        text = np.full((stop - start, max(int(nx.max()), 1)), len(chars), np.int64)
        text[ox, px] = code[ends_x[start]:ends_x[stop]]
        rows, v = np.arange(stop - start), np.full(stop - start, ~np.uint64(0))
        for step in range(text.shape[1]):
            u = v & masks[rows, text[:, step]]
            v = (v + u) | (v - u)
        short = (ny > 0) & (ny <= 64)
        common = np.bitwise_count(~v[short] & (~np.uint64(0) >> (64 - ny[short]).astype(np.uint64)))
        out[start:stop][short] = common >= (floor / 2 * (nx + ny) - 1e-9)[short]
    return out


def may_reach_column(a: Column, b: Column, floor: float) -> Column:
    """Condition: the ratio of a and b may reach `floor`."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        known[known] = pairs_may_reach(x[known].tolist(), y[known].tolist(), floor)
        return pd.Series(known)

    return F.pandas_udf(run, T.BooleanType())(a, b)


@F.pandas_udf(T.DoubleType())
def seq_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """2*M/(len a + len b), M from the longest-block recursion; not symmetric. Null in, null out."""
    known: dict[tuple[str, str], float] = {}
    for a, b in batches:
        if len(known) > KNOWN_PAIRS:
            known.clear()
        out: list[float | None] = [None] * len(a)
        for i, pair in enumerate(zip(a, b)):
            if pair[0] is None or pair[1] is None:
                continue
            ratio = known.get(pair)
            if ratio is None:
                size = len(pair[0]) + len(pair[1])
                ratio = known[pair] = 2.0 * matched_characters(*pair) / size if size else 1.0
            out[i] = ratio
        yield pd.Series(out, dtype="float64")


# Marked so that the optimizer neither moves the call into a join condition nor computes it twice.
seq_ratio = seq_ratio.asNondeterministic()


def register(spark) -> None:
    """Make the ratio usable from SQL as seq_ratio(a, b)."""
    spark.udf.register("seq_ratio", seq_ratio)


def contained_ratio(a: Column, b: Column) -> Column:
    """Closed form of the ratio where one text contains the other, else null.

    The longest block is then the whole shorter text, so M is its length.
    """
    plain = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(
        plain & (a.contains(b) | b.contains(a)),
        F.lit(2.0) * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)),
    )


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the lengths alone."""
    return F.lit(2.0) * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def numbered_chars(c: Column) -> Column:
    """Characters with their running count ('a1','b1','a2', …): a multiset as a set."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(
        chars,
        lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")),
    )


def shared_char_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the characters both texts have."""
    shared = F.size(F.array_intersect(numbered_chars(a), numbered_chars(b)))
    return F.lit(2.0) * shared / (F.length(a) + F.length(b))


def plain_ratio(a: Column, b: Column) -> Column:
    """The ratio: closed form where one text contains the other, Python for the other pairs."""
    exact = contained_ratio(a, b)
    return F.coalesce(exact, seq_ratio(F.when(exact.isNull(), a), b))


def _ratio_if_near(floor: float):
    """The ratio of pairs that may reach `floor`, null for the others: one worker a task judges and scores."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.tolist(), y.tolist()
        out = np.full(len(x), np.nan)
        near = pairs_may_reach(x, y, floor) if floor > 0 else np.ones(len(x), bool)
        for k in np.flatnonzero(near):
            out[k] = 2.0 * matched_characters(x[k], y[k]) / (len(x[k]) + len(y[k]))
        return pd.Series(out).astype("Float64").where(near)

    return F.pandas_udf(run, T.DoubleType()).asNondeterministic()


def with_ratio(pairs: DataFrame, a: str, b: str, floor: float, out: str, also: Column | None = None) -> DataFrame:
    """Pairs whose ratio can reach `floor` (or that `also` keeps), with the ratio. Python sees only undecided pairs."""
    x, y = F.col(a), F.col(b)
    exact = contained_ratio(x, y)
    near = length_bound(x, y) >= floor
    decided = pairs.withColumn(out, exact).where(F.col(out).isNotNull())
    if also is None:
        undecided = pairs.where(exact.isNull() & near).withColumn(out, _ratio_if_near(floor)(x, y)).where(F.col(out).isNotNull())
    else:
        near = near & may_reach_column(x, y, floor) if floor > 0 else near
        undecided = pairs.where(exact.isNull() & (also | near)).withColumn(out, seq_ratio(x, y))
    return decided.unionByName(undecided)


def store_similarity(a: Column, b: Column, ratio: Column, brand_prefixes: Sequence[str] = (),
                     char_class: str = tx.CJK) -> Column:
    """Composite store similarity; may exceed 1. `ratio` belongs to the names without brand prefix."""
    x, y = tx.strip_first_prefix(a, brand_prefixes), tx.strip_first_prefix(b, brand_prefixes)
    shorter = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    longer = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    contained = F.when(
        (F.length(shorter) > 0) & longer.contains(shorter),
        F.length(shorter) / F.length(longer) + F.lit(0.3),
    ).otherwise(0.0)
    shared = F.size(F.array_intersect(tx.place_words(x, char_class=char_class), tx.place_words(y, char_class=char_class)))
    return F.when((a == "") | (b == ""), 0.0).otherwise(
        F.greatest(ratio, contained, ratio + F.least(shared * F.lit(0.2), F.lit(0.6))))


def match_score(layer: str, name_score: Column, spec: Column, boost: Column, same_unit: Column, same_spec: Column) -> Column:
    """Weighted match score of one layer, at most 1."""
    from ..fixed_values import MATCH_WEIGHTS, SPEC_BONUS, UNIT_BONUS

    w = MATCH_WEIGHTS[layer]
    total = name_score * w["name"] + spec * w["spec"] + boost * w["boost"]
    total = total + F.when(same_unit, UNIT_BONUS).otherwise(0.0) + F.when(same_spec, SPEC_BONUS).otherwise(0.0)
    return F.least(total, F.lit(1.0))
