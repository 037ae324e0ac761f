"""Labelled attempts of run folders and the build that turns them into parts: one job for all units that have none yet.

Order of a build: settings against what is there, a manifest, parts, each unit's record, the table of system prompts,
the manifest again. A unit is done when its record is there, and records come after parts, so a build that is killed
leaves units that the next one builds anew; a part is a folder that is replaced whole.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Cuts, Labels
from ..functions import labels as L
from ..functions.texts import cut_points_udf
from . import readers, runs, sinks
from .scratch import written

UNIT = ["run_name", "shard"]
SCHEMA_VERSION = 1
#: Why an attempt has no row, in the order in which the rules are asked.
REASONS = ["no_eval_entry", "excluded", "truncated", "no_finish_reason", "no_runtime", "no_baseline", "tokenize_failed", "too_long", "no_cuts"]
PARTS, RECORDS, PROMPTS, MANIFEST = "parts", "records", "system_prompts", "manifest.json"
#: Columns of a built row.
ROW = [*UNIT, "level", "problem_id", "sample_id", "stem", "system_prompt_sha1", "prompt", "raw", "cuts", "n_prompt_tokens", "n_raw_tokens", "compiled", "correct", "speedup", "speedup_min", "target", "label"]


def labelled(spark: SparkSession, units: DataFrame) -> DataFrame:
    """Every attempt of the units (run_name, shard, attempts, verdicts) with its verdict: ``matched`` (whether there is one), compiled, correct, runtime, runtime_min and the truncation state. Two verdicts for one attempt are an error, and so is a line that is no record."""
    found = units.select(*UNIT, "attempts", "verdicts").collect()  # a row a shard
    where = spark.createDataFrame([(r["run_name"], r["shard"], kind, sinks.qualified(spark, r[kind])) for r in found for kind in ("attempts", "verdicts")], "run_name string, shard string, kind string, path string")

    def named(df: DataFrame, kind: str) -> DataFrame:
        """Rows under the unit whose file they are from, whatever their folders are called."""
        same = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
        path = where.where(F.col("kind") == kind).select(same(F.col("path")).alias("_path"), *UNIT)
        return df.withColumn("_path", same(F.col("_metadata.file_path"))).join(F.broadcast(path), "_path").drop("_path")  # a row a shard

    a = named(spark.read.schema(f"{readers.ATTEMPTS}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json([r["attempts"] for r in found]), "attempts")
    bad = F.col("_corrupt").isNotNull() | F.col("problem_id").isNull() | F.col("sample_id").isNull() | F.col("level").isNull() | F.col("raw").isNull()
    a = a.withColumn("stem", F.when(bad, F.raise_error(F.concat(F.lit("not an attempt: "), F.coalesce("_corrupt", "stem", F.lit("")), F.lit(" of "), "run_name", F.lit("/"), "shard"))).otherwise(F.col("stem"))).drop("_corrupt", "confidence", "code", "problem_name")
    v = named(spark.read.text([r["verdicts"] for r in found], wholetext=True), "verdicts")
    v = v.select(*UNIT, F.explode(F.from_json("value", f"map<string,array<{readers.VERDICT}>>", {"mode": "FAILFAST"})).alias("pid", "vs")).select(*UNIT, F.col("pid").cast("long").alias("problem_id"), F.explode("vs").alias("v"))
    v = readers.require_unique(v.select(*UNIT, "problem_id", F.col("v.sample_id").alias("sample_id"), "v"), [*UNIT, "problem_id", "sample_id"], "verdict")
    d = a.join(v, [*UNIT, "problem_id", "sample_id"], "left")
    no = F.lit(False)
    return d.select(
        *UNIT, "level", "problem_id", "sample_id", "stem", "system_prompt", "prompt", "raw",
        F.col("v").isNotNull().alias("matched"), F.coalesce("v.compiled", no).alias("compiled"), F.coalesce("v.correctness", no).alias("correct"),
        F.col("v.runtime").alias("runtime"), F.col("v.runtime_stats.min").alias("runtime_min"), L.truncation_state(F.col("trace")).alias("truncation"),
    )


def attempt_counts(labelled: DataFrame) -> DataFrame:
    """(run_name, shard, attempts, labelled, no_eval_entry): attempts without a verdict are counted, never guessed."""
    return labelled.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("attempts"), F.count_if("matched").alias("labelled"), F.count_if(~F.col("matched")).alias("no_eval_entry"))


def graded(d: DataFrame, baselines: DataFrame, excluded: DataFrame | None, labels: Labels, cuts: Cuts, count) -> DataFrame:
    """Rows with everything that a part holds and ``drop_reason``, the first of REASONS that holds (null: kept). ``count``: a column of tokens from a column of text. A cut point counts from ``min_frac`` of the text on and keeps its number."""
    key = ["level", "problem_id"]
    base = baselines.groupBy(*key).agg(F.max("mean").alias("base_mean"), F.max("min").alias("base_min"))
    out = (excluded if excluded is not None else d.select(*key).limit(0)).select(*key).distinct().withColumn("out", F.lit(True))
    d = d.join(base, key, "left").join(out, key, "left")
    d = d.withColumns({"label": L.label(F.col("compiled"), F.col("correct")), "speedup": L.speedup(F.col("correct"), F.col("runtime"), F.col("base_mean")), "speedup_min": L.speedup(F.col("correct"), F.col("runtime_min"), F.col("base_min"))})
    graded_by, timed_by = ("speedup_min", "base_min") if labels.speedup_stat == "min" else ("speedup", "base_mean")
    scale = dict(lo=labels.speedup_lo, hi=labels.speedup_hi, quant=labels.speed_quant)
    d = d.withColumns({"target": L.target(F.col("label"), F.col(graded_by), labels.label_mode, **scale), "n_prompt_tokens": count(F.col("prompt")), "n_raw_tokens": count(F.col("raw"))})
    d = d.withColumn("all_cuts", cut_points_udf("raw", F.lit(cuts.prose_lines_per_chunk), F.lit(cuts.code_steps_per_chunk)))
    d = d.withColumn("cuts", F.filter("all_cuts", lambda c: c["char"] >= cuts.min_frac * F.length("raw")))
    ungraded = F.col("target").isNull()
    rules = {
        "no_eval_entry": ~F.col("matched"),
        "excluded": F.col("out").isNotNull(),
        "truncated": F.col("truncation") == L.TRUNCATED,
        "no_finish_reason": F.col("truncation") != L.OK,
        "no_runtime": ungraded & L.usable(F.col(timed_by)),
        "no_baseline": ungraded,
        "tokenize_failed": F.col("all_cuts").isNull(),
        "too_long": F.col("n_prompt_tokens") + F.col("n_raw_tokens") > cuts.max_length,
        "no_cuts": F.size("cuts") == 0,
    }
    sha = F.sha1(F.coalesce("system_prompt", F.lit("")).cast("binary"))
    return d.withColumns({"drop_reason": L.first_reason(*rules.items()), "system_prompt_sha1": sha}).drop("all_cuts", "out")


def records_of(rows: DataFrame) -> DataFrame:
    """(run_name, shard, record JSON) of built rows: counts of rows, cuts and each reason, and the stems that were dropped."""
    kept = F.col("drop_reason").isNull()
    counts = [F.count_if(kept).alias("rows"), F.coalesce(F.sum(F.when(kept, F.size("cuts"))), F.lit(0)).alias("cuts"), *(F.count_if(F.col("drop_reason") == r).alias(r) for r in REASONS)]
    stems = [F.array_sort(F.collect_list(F.when(F.col("drop_reason") == r, F.col("stem")))).alias(r) for r in REASONS[1:]]  # drops of one shard: hundreds
    g = rows.groupBy(*UNIT).agg(F.struct(*counts).alias("counts"), F.struct(*stems).alias("dropped"))
    return g.select(*UNIT, F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "counts", "dropped")).alias("record"))


def _records(spark: SparkSession, out: str) -> dict[str, dict]:
    """Part name to record, of all units that are done: a small row each."""
    if not sinks.exists(spark, f"{out}/{RECORDS}"):
        return {}
    d = spark.read.parquet(f"{out}/{RECORDS}").select(runs.part_name(F.col("run_name"), F.col("shard")).alias("part"), "record")
    return {r["part"]: json.loads(r["record"]) for r in d.collect()}


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*UNIT).parquet(path)


def build_corpus(spark: SparkSession, roots: list[str], out: str, baseline: str, exclusions: str | None = None, labels: Labels | None = None, cuts: Cuts | None = None, count=None, max_shards: int | None = None) -> dict:
    """Build every unit of the run folders that has no part yet under ``out``; returns the manifest. Units that are there must have been built under the same settings, from the same baseline and exclusions."""
    labels, cuts = labels or Labels(), cuts or Cuts()
    count = count or (lambda text: F.size(F.split(F.trim(text), r"\s+")))
    units = runs.units(spark, roots, max_shards)
    skipped = [(r["run_name"], r["shard"], r["skipped"]) for r in units.where("skipped IS NOT NULL").orderBy(*UNIT).collect()]
    base, excluded = readers.baseline_times(spark, baseline), readers.exclusions(spark, exclusions) if exclusions else None
    shas = {"baseline_sha1": sinks.sha1_of(spark, baseline), "exclude_sha1": sinks.sha1_of(spark, exclusions) if exclusions else None}
    knobs = {**asdict(labels), **asdict(cuts)}
    held = _records(spark, out)
    path = f"{out}/{MANIFEST}"
    if held:
        sinks.check_resume(json.loads(sinks.read_text(spark, path) or "{}"), knobs, shas, out)
        sinks.check_schema(held, SCHEMA_VERSION, out)

    def stamp(built: int) -> dict:
        m = sinks.manifest(_records(spark, out), REASONS, knobs, built, skipped, **shas)
        sinks.write_atomic(spark, path, json.dumps(m, indent=2))
        return m

    stamp(0)  # a build that is killed leaves parts, and the next one asks what built them
    names = spark.createDataFrame([(n,) for n in held], "part string")
    todo = units.where("skipped IS NULL").withColumn("part", runs.part_name(F.col("run_name"), F.col("shard"))).join(names, "part", "left_anti").drop("part")
    n = todo.count()
    if n:
        rows = written(graded(labelled(spark, todo), base, excluded, labels, cuts, count), "corpus")
        _replace(rows.where("drop_reason IS NULL").select(*ROW), f"{out}/{PARTS}")
        prompts = rows.where("drop_reason IS NULL").select("system_prompt_sha1", "system_prompt", *UNIT).distinct()
        _replace(prompts, f"{out}/{PROMPTS}")
        _replace(records_of(rows), f"{out}/{RECORDS}")
    return stamp(n)


def corpus_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all units that are done."""
    done = spark.read.parquet(f"{out}/{RECORDS}").select(*UNIT)
    return spark.read.parquet(f"{out}/{PARTS}").join(done, UNIT, "left_semi")


def prompts(spark: SparkSession, out: str) -> DataFrame:
    """(system_prompt_sha1, system_prompt): what the rows' hashes stand for."""
    return spark.read.parquet(f"{out}/{PROMPTS}").select("system_prompt_sha1", "system_prompt").distinct()




#: Truncated attempts that a sound corpus has at most, and points by which keeping rows may move the rate of correct ones.
MAX_TRUNCATED, MAX_SHIFT_POINTS = 100, 0.5


def corpus_checks(spark: SparkSession, out: str, roots: list[str], labels: Labels | None = None, cuts: Cuts | None = None, splits: DataFrame | None = None, max_shards: int | None = None) -> DataFrame:
    """(check, ok, detail): whether a built corpus may be used. What the manifest says is held against the rows on disk and against the run folders: one pass over the rows, one over the verdicts, small joins for prompts and splits."""
    m = json.loads(sinks.read_text(spark, f"{out}/{MANIFEST}") or "{}")
    counts, was = m.get("counts", {}), m.get("config", {})
    knobs = {**asdict(labels or Labels()), **asdict(cuts or Cuts())}
    moved = sorted(k for k, v in knobs.items() if was.get(k) != v)
    rows = corpus_rows(spark, out)
    t = F.col("target")
    on_scale = F.when(F.col("label") == 1, t.between(0.5, 1.0)).otherwise(t == 0.0)
    one = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("cuts")), F.lit(0)).alias("cuts"), F.count_if("correct").alias("correct"), F.count_if(~on_scale).alias("off_scale"), F.count_if((t > 0) & (t < 0.5)).alias("band")).first()
    units = runs.units(spark, roots, max_shards).where("skipped IS NULL")
    found = units.count()
    every = labelled(spark, units).agg(F.count(F.lit(1)).alias("attempts"), F.count_if("matched").alias("graded"), F.count_if(F.col("matched") & F.col("correct")).alias("correct")).first()
    percent = lambda n, d: 100.0 * n / d if d else 0.0
    shift = percent(one["correct"], one["rows"]) - percent(every["correct"], every["graded"])
    lost = rows.select("system_prompt_sha1").distinct().join(prompts(spark, out), "system_prompt_sha1", "left_anti").count()
    problems = rows.select("level", "problem_id").distinct()
    unsplit = problems.join(splits.select("level", "problem_id"), ["level", "problem_id"], "left_anti").count() if splits is not None else None
    unjoined = counts.get("no_eval_entry", 0)
    checks = [
        ("report config matches the build's", not moved, f"moved: {', '.join(moved) or 'none'}"),
        ("rows on disk match the manifest", one["rows"] == counts.get("rows", 0), f"{one['rows']} on disk, {counts.get('rows', 0)} in the manifest"),
        ("cuts on disk match the manifest", one["cuts"] == counts.get("cuts", 0), f"{one['cuts']} on disk, {counts.get('cuts', 0)} in the manifest"),
        ("provenance recorded", bool(m.get("baseline_sha1")), f"baseline {m.get('baseline_sha1')}"),
        ("one part per unit the config resolves", m.get("parts") == found, f"{m.get('parts')} parts, {found} units"),
        ("every target on the graded scale", one["off_scale"] == 0, f"{one['off_scale']} rows"),
        ("nothing in the empty (0, 0.5) band", one["band"] == 0, f"{one['band']} rows"),
        (f"truncated under {MAX_TRUNCATED}", counts.get("truncated", 0) <= MAX_TRUNCATED, f"{counts.get('truncated', 0)} attempts"),
        (f"base-rate shift under {MAX_SHIFT_POINTS} points", abs(shift) < MAX_SHIFT_POINTS, f"{shift:+.3f} points"),
        ("every attempt reconciles with a verdict", every["graded"] == m.get("attempts", 0) - unjoined, f"{every['graded']} verdicts, {m.get('attempts', 0) - unjoined} attempts joined"),
        ("no attempt is missing its verdict", unjoined == 0, f"{unjoined} attempts"),
        ("every system prompt resolves", lost == 0, f"{lost} hashes without a text"),
        ("every problem has a split", unsplit == 0, "no splits" if unsplit is None else f"{unsplit} problems without one"),
    ]
    return spark.createDataFrame(checks, "check string, ok boolean, detail string")
