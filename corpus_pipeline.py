"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, whatever they are named. ``run`` writes each stage's rows as Parquet in the shared folder, reads
them back for the next one and deletes what the stage wrote besides.

All stages: very long texts are taken whole; other columns are kept as they are (the last stage has its own); an empty
table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from tallyloom.llm.runtime import drop_since, mark, materialize, release, table

N_SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep. A null or empty text goes; equal rows go or stay together."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more. The smallest doc_id stays (null last), of repeated ids one row; a text without words stays."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or nearly so. A null or empty text or item matches nothing; equal rows go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target and its own draw take it. A null source is a source of its own; equal rows are separate documents."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row. A null text has no bytes; equal rows have slots of their own."""
    return sharding.shard(docs, N_SHARDS)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The near-duplicate and edit-distance stages have no SQL form that ends; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        since = mark()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
            drop_since(since)
            release(spark)
    return docs
