"""Readers of run folders with explicit schemas, and sinks. Paths go to Spark's readers only, so any Hadoop store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import require_unique

TRACE = "struct<passes:int,plan_finish_reason:string,code_finish_reason:string>"
ATTEMPTS = f"stem string, level int, problem_id long, sample_id long, problem_name string, system_prompt string, prompt string, raw string, code string, trace {TRACE}, confidence map<string,double>"
VERDICT = "struct<sample_id:long,compiled:boolean,correctness:boolean,runtime:double,runtime_stats:struct<mean:double,min:double,std:double>,metadata:struct<hardware:string,runtime_error_name:string>>"
ROLLOUTS = "rollout_id string, prefix_id string, level int, problem_id long, raw string, code string, code_sha1 string, n_gen_tokens long, finish_reason struct<plan:string,code:string>, staged_as struct<run_name:string,sample_id:long>"
SCORES = "kind string, id string, level int, problem_id long, code_sha1 string, orm_score double, orm_checkpoint_sha string, n_code_tokens long"
LISTS = "list_key string, run_tag string, level int, problem_id long, cut_index int, rel_depth_mean double, split string, source string, label_source string, items array<struct<prefix_id:string,rel:double,n_rollouts:long,se:double>>"
PREFIXES = "prefix_id string, run_name string, shard string, level int, problem_id long, sample_id long, stem string, cut_index int, cut_char int, cut_kind string, rel_depth double, n_cuts_total int, split string, origin string"


def _located(df: DataFrame) -> DataFrame:
    """run_name and shard from the path .../<run>/<shard>/<file>."""
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("run_name"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("shard"))


def attempts(spark: SparkSession, path: str) -> DataFrame:
    return _located(spark.read.schema(ATTEMPTS).json(path))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(run_name, shard, problem_id, sample_id, compiled, ...) from maps of problem to verdict arrays; a repeated key is an error."""
    raw = _located(spark.read.text(path, wholetext=True))
    v = raw.select("run_name", "shard", F.explode(F.from_json("value", f"map<string,array<{VERDICT}>>")).alias("pid", "vs")).select("run_name", "shard", F.col("pid").cast("long").alias("problem_id"), F.explode("vs").alias("v"))
    return require_unique(v.select("run_name", "shard", "problem_id", "v.*"), ["run_name", "shard", "problem_id", "sample_id"], "verdict")


def baseline_times(spark: SparkSession, path: str) -> DataFrame:
    """(level, problem_id, name, mean, min) from map level<n> of map <id>_Name to times; malformed keys drop out."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,struct<mean:double,min:double,std:double>>>")).alias("lv", "files"))
    t = raw.select("lv", F.explode("files").alias("name", "t")).where(F.col("lv").rlike(r"level\d+$") & F.col("name").rlike(r"^\d+_") & F.col("t.mean").isNotNull())
    return t.select(F.regexp_extract("lv", r"level(\d+)$", 1).cast("int").alias("level"), F.regexp_extract("name", r"^(\d+)_", 1).cast("long").alias("problem_id"), "name", "t.mean", "t.min")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(level, problem_id) from map level<n> of ids; other keys are ignored, and no level at all is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")).where(F.col("k").rlike(r"^level\d+$"))
    out = raw.select(F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("level"), F.explode(F.from_json("v", "array<long>")).alias("problem_id"))
    if out.isEmpty():
        raise ValueError(f"no exclusions in {path}")
    return out


def rollouts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROLLOUTS).json(path)


def prefixes(spark: SparkSession, path: str) -> DataFrame:
    """Prefix rows; a validation prefix must be random and unscored."""
    p = spark.read.schema(PREFIXES).json(path)
    if not p.where("split = 'val' AND coalesce(origin, '') <> 'random'").isEmpty():
        raise ValueError("validation prefixes must be random")
    return p


def lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTS).json(path)


def scores(spark: SparkSession, path: str, anchors: bool = False) -> DataFrame:
    """The last row of each id, by file and row order; anchors live in their own part and share one checkpoint."""
    s = spark.read.schema(SCORES).json(path).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    s = s.where(F.col("_f").contains("_anchors") if anchors else ~F.col("_f").contains("_anchors") & (F.col("kind") == "rollout"))
    s = s.groupBy("id").agg(F.max_by(F.struct("kind", "level", "problem_id", "code_sha1", "orm_score", "orm_checkpoint_sha", "n_code_tokens"), F.struct("_f", "_i")).alias("x")).select("id", "x.*")
    if anchors and s.select("orm_checkpoint_sha").distinct().limit(2).count() > 1:
        raise ValueError("anchor scores of several checkpoints")
    return s


def kernel_files(spark: SparkSession, path: str) -> DataFrame:
    """(level, problem_id, sample_id, source) of level_L_problem_P_sample_S_kernel.py files; other names drop out."""
    name = r"level_(\d+)_problem_(\d+)_sample_(\d+)_kernel\.py$"
    f = spark.read.text(path, wholetext=True, pathGlobFilter="*_kernel.py").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("source")).where(F.col("file").rlike(name))
    return f.select(*(F.regexp_extract("file", name, i).cast("long").alias(c) for i, c in enumerate(("level", "problem_id", "sample_id"), 1)), "file", "source")


def write_parts(df: DataFrame, path: str) -> None:
    """Parts by run and shard; only the partitions in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name", "shard").parquet(path)


def todo(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units without a finished part."""
    return units.join(done.select("run_name", "shard").distinct(), ["run_name", "shard"], "left_anti")
