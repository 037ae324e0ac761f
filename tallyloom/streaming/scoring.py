"""Scoring that is paid for once a text: a stream of items against what has been scored, in parts that a rerun replaces.

Each micro-batch joins its distinct texts to the scores that earlier batches left and scores the rest. Its part is
named by the batch, and a batch looks at parts before its own only, so a batch that runs again after a crash makes the
same part once more and nothing is scored or counted twice. A part counts once its marker is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import extract_code_udf
from ..sources.sinks import exists

SCORES, ITEMS = "scores", "items"


def text_sha(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))


def anchor_items(rows: DataFrame) -> DataFrame:
    """Graded attempts (run_name, shard, stem, level, problem_id, raw) as items; their code is taken from the raw text again."""
    code = extract_code_udf("raw")
    return rows.select(F.lit("anchor").alias("kind"), F.concat_ws("__", "run_name", "shard", "stem").alias("id"), "level", "problem_id", code.alias("code")).withColumn("code_sha1", text_sha(F.col("code")))


def rollout_items(rollouts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rollouts under the level and problem of their prefixes; the code is what generation stored, never taken out again. A rollout without a prefix is left out."""
    home = prefixes.select("prefix_id", "level", "problem_id")
    kept = rollouts.drop("level", "problem_id").join(home, "prefix_id")
    return kept.select(F.lit("rollout").alias("kind"), F.col("rollout_id").alias("id"), "level", "problem_id", "code", F.coalesce("code_sha1", text_sha(F.col("code"))).alias("code_sha1"))


def _part(out: str, table: str, batch: int) -> str:
    return f"{out}/{table}/batch={batch}"


def committed(spark: SparkSession, out: str, table: str, before: int | None = None) -> DataFrame | None:
    """The rows of finished parts, of batches under ``before``; None if there is none."""
    if not exists(spark, f"{out}/{table}"):
        return None
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{out}/{table}")
    parts = [x.getPath() for x in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where) if x.isDirectory()]
    done = [str(p.toString()) for p in parts if p.getName().startswith("batch=") and exists(spark, f"{p.toString()}/_SUCCESS") and (before is None or int(p.getName()[6:]) < before)]
    return spark.read.option("basePath", f"{out}/{table}").parquet(*done) if done else None


def score_batch(items: DataFrame, batch: int, out: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch: its unseen texts through ``score`` (code_sha1, code -> with orm_score), then its items. The scores are in place before the items that need them."""
    spark = items.sparkSession
    texts = items.groupBy("code_sha1").agg(F.min("code").alias("code"))
    seen = committed(spark, out, SCORES, batch)
    fresh = texts if seen is None else texts.join(seen.select("code_sha1"), "code_sha1", "left_anti")
    score(fresh).select("code_sha1", "orm_score").write.mode("overwrite").parquet(_part(out, SCORES, batch))
    items.drop("code").write.mode("overwrite").parquet(_part(out, ITEMS, batch))


def score_stream(items: DataFrame, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> list[int]:
    """All that is new in a streaming ``items`` (kind, id, level, problem_id, code, code_sha1), then stop; the batches that ran."""
    ran: list[int] = []

    def each(df: DataFrame, batch: int) -> None:
        score_batch(df, batch, out, score)
        ran.append(batch)

    items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ran


def scored_items(spark: SparkSession, out: str) -> DataFrame:
    """Every item with its score: the last batch's row of an id, joined to the one score of its text."""
    items = committed(spark, out, ITEMS)
    last = items.groupBy("kind", "id").agg(F.max_by(F.struct("level", "problem_id", "code_sha1"), "batch").alias("x")).select("kind", "id", "x.*")
    return last.join(committed(spark, out, SCORES).select("code_sha1", "orm_score"), "code_sha1")
