"""The thin queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, hard_negatives, license_scan, mixing, ngram_join, pii, quality_rules, sharding, spelling, toxicity, url_filter
from .runtime import table
from .substring_dedup import dedup_substrings


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), window=35, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.tag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved, scale=256, positives=5, negatives=10, percent=(30, 90))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.words(table(spark, sf_dir, "documents"), drop_one_in=199), least_letters=6, least_n=5, times=5)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_ngram_join": op5_ngram_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling": op12_spelling,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op2_license_scan": license_scan.oracle(),
    "op8_quality_rules": quality_rules.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
