"""The static checks over a run folder, held against how its samples came off: kernels, references and verdicts joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import staticcheck as S
from . import readers, runs

KEY = ["level", "problem_id", "sample_id"]
SUMMARY = ["parse_status", "n_kernels", "n_launches", "launches_in_loop", "wasted_bytes", "n_fail"]


def scan_run(spark: SparkSession, folder: str, references: str | None = None) -> DataFrame:
    """(level, problem_id, sample_id, file, source, report) of every kernel of a run; ``references``: a level folder whose sources lend sizes to programs without inputs of their own."""
    kernels = readers.kernel_files(spark, folder)
    if references is None:
        return S.scan(kernels)
    known = runs.references(spark, references).select("problem_id", "name")
    text = spark.read.text(references, wholetext=True, pathGlobFilter="*.py").select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("reference"))
    return S.scan(kernels, references=known.join(text, "name").select("problem_id", "reference"), by=["problem_id"])


def outcome_rows(spark: SparkSession, folder: str, scanned: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """A row for each sample with a verdict and a report: its outcome, its speedup over the baseline by the report's rule, the report's counts, and a flag for each registered check."""
    v = runs.samples(spark, folder).drop("file")
    if baselines is not None:
        v = v.join(baselines.groupBy("level", "problem_id").agg(F.max("mean").alias("base")), ["level", "problem_id"], "left")
    else:
        v = v.withColumn("base", F.lit(None).cast("double"))
    v = v.withColumn("speedup", L.report_speedup(F.col("correct"), F.col("runtime"), F.col("base"))).drop("base")
    flagged = S.flags(scanned).select(*KEY, *(F.col(f"report.{c}").alias(c) for c in SUMMARY), *(c.replace(".", "_") for c in S.CHECKS))
    return v.join(flagged, KEY)


def outcome_report(rows: DataFrame) -> DataFrame:
    """For each check: samples, flag rate, and shares correct and median speedups of flagged and clean samples."""
    d = rows.withColumn("right", F.col("correct").cast("int"))
    out = S.outcomes(d, [c.replace(".", "_") for c in S.CHECKS], "right", "speedup")
    return out.withColumn("check_id", F.replace("check_id", F.lit("_"), F.lit(".")))
