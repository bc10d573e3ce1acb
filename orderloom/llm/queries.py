"""Registered queries of these operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, decontaminate, minhash, neighbours, packing, passages, quality, repeats, secrets, simhash, spelling, toxicity, url_rules

# The rules of the url query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(read(spark, folder, "documents"))


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, folder, "pages"), URL_RULES)


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.passage_classes(read(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op7_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op9_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return quality.resample(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.fingerprint_report(read(spark, folder, "documents"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secrets, op2_url_rules, op3_neighbours, op4_passages, op5_simhash, op6_toxicity, op7_suffix_repeats, op8_decontamination, op9_importance_resampling, op10_packing,
    op11_minhash, op12_alignment, op13_spelling)}

ORACLES = {
    "op2_url_rules": """
        WITH cut AS (
          SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
          ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        SELECT page_id, host, path, max(h || p) FILTER (WHERE k = 1) AS rule, coalesce(max(v) FILTER (WHERE k = 1), 'allow') AS verdict
        FROM (SELECT cut.*, h, p, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
          FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        GROUP BY page_id, host, path""",
}
