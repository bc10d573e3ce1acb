"""Allow and block rules for urls: a broadcast trie over reversed host labels and path segments, the longest match wins.

Edge cases: a null url or one without `://` has an empty host and path and fits no rule; no rule gives the default
verdict; repeated rows are judged alike and kept; an empty table gives an empty result; of equal rules with both
verdicts, block stays.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

#: A trie of at most so many rules is sent to the executors; a longer rule table is joined instead.
MAX_TRIE_RULES = 200_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the last to the first; None leads to the path part of a host's rules.

    In the path part whole segments are keys. The piece of a rule's path after its last slash, which may end within
    a segment of the url, stands with the verdict under "" of the node that it hangs from.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault(("/", segment), {})
        ends = node.setdefault("", {})
        if ends.get(rest, (None, None))[1] != "block":
            ends[rest] = (f"{host}{path}", verdict)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The rule with most characters that fits; of equally long ones that with more host labels."""
    best: tuple[str | None, str | None] = (None, None)
    pieces = path.split("/")
    node, labels = trie, host.split(".")[::-1] if host else []
    for depth in range(len(labels) + 1):
        at = node.get(None)
        for i, piece in enumerate(pieces):
            if at is None:
                break
            rest = "/".join(pieces[i:])
            for end, hit in at.get("", {}).items():
                if rest.startswith(end) and len(hit[0]) >= len(best[0] or ""):
                    best = hit
            at = at.get(("/", piece)) if i + 1 < len(pieces) else None
        if depth == len(labels):
            break
        node = node.get(labels[depth])
        if node is None:
            break
    return best


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], key: str = "page_id", default: str = "allow",
               max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """key, host, path, rule and verdict of each row of pages (key, url). rules: (host, path, verdict) rows.

    The trie is broadcast only while the rules are at most max_trie_rules. A longer rule table is joined on each
    url's (host suffix, path prefix) keys, with the same result.
    """
    rows = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        taken = rules.select("host", "path", "verdict").limit(max_trie_rules + 1).collect()
        if len(taken) > max_trie_rules:
            return _judge_by_join(rows, rules, key, default)
        rules = [tuple(r) for r in taken]
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [longest_match(trie.value, h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v for _, v in found]}, dtype=object)

    matched = F.pandas_udf(match, "rule string, verdict string")
    return (rows.withColumn("hit", matched("host", "path"))
            .select(key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))


def _judge_by_join(rows: DataFrame, rules: DataFrame, key: str, default: str) -> DataFrame:
    """Distinct (host, path) pairs meet the rules on host suffix and hashed path prefix; lengths of rule paths bound the prefixes."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    seen = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    keys = (seen.select("host", "path", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))).alias("h"))
            .select("host", "path", "h", F.explode(fits).alias("n"))
            .select("host", "path", "h", F.substring("path", F.lit(1), F.col("n")).alias("p")))
    table = rules.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("verdict").alias("v"))
    best = (keys.join(table, ["h", "p"]).groupBy("host", "path")
            .agg(F.max(F.struct(F.length(F.concat("h", "p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), "v")).alias("b")))
    return (rows.join(best, ["host", "path"], "left")
            .select(key, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict")))
