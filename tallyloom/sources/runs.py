"""Run folders: which files a run has, its layout, settings, samples, references and problems.

Listings come from Spark's file source (paths only, no content is read), so any store that Spark reads will do, and a
folder of many files is a table like any other.
"""

from __future__ import annotations

import itertools
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import parse_int_spec
from ..operators.build import require_unique
from . import readers

#: File names of a run folder.
EVAL, ATTEMPTS, CONFIG = "eval_results.json", "attempts.jsonl", "generation_config.yaml"
KERNEL = r"level_(\d+)_problem_(\d+)_sample_(\d+)_kernel\.py$"


def listing(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """(path, rel) of all files under ``root``; ``rel`` from the root on."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    folder = re.sub(r"^[A-Za-z0-9.+-]+:(//[^/]*)?", "", root).rstrip("/") + "/"
    return f.select("path", F.get(F.split("path", re.escape(folder), 2), F.lit(1)).alias("rel"))


def layout(rel: Column) -> dict[str, Column]:
    """shard (null for a run without), and the part below the leaf, of a path below a run folder."""
    shard = F.nullif(F.regexp_extract(rel, r"^(shard_[^/]*)/", 1), F.lit(""))
    return {"shard": shard, "below": F.regexp_replace(rel, r"^shard_[^/]*/", "")}


def leaves(spark: SparkSession, root: str) -> DataFrame:
    """A row for each leaf (a shard_* folder, or the run itself without any): shard, where its kernels and traces lie below it, and whether verdicts and attempts lie there. Kernels of a first round (rounds/round_0, traces/round_0) are read instead where they exist."""
    f = listing(spark, root)
    parts = layout(F.col("rel"))
    f = f.select(parts["shard"].alias("shard"), parts["below"].alias("below"))
    sharded = not f.where("shard IS NOT NULL").isEmpty()
    f = f.where("shard IS NOT NULL" if sharded else "shard IS NULL")
    below = F.col("below")
    g = f.groupBy("shard").agg(
        F.bool_or(below.startswith("rounds/round_0/")).alias("old_kernels"),
        F.bool_or(below.startswith("traces/round_0/")).alias("old_traces"),
        F.collect_set(F.when(below.rlike(rf"(^|/)({EVAL}|{ATTEMPTS})$"), below)).alias("found"),
    )
    kernels = F.when(F.col("old_kernels"), "rounds/round_0/").otherwise("")
    traces = F.when(F.col("old_traces"), "traces/round_0/").otherwise("traces/")
    return g.select("shard", kernels.alias("kernels"), traces.alias("traces"), F.array_contains("found", F.concat(kernels, F.lit(EVAL))).alias("has_eval"), F.array_contains("found", F.concat(traces, F.lit(ATTEMPTS))).alias("has_attempts"))


def _name(root: str) -> str:
    return root.rstrip("/").rsplit("/", 1)[-1]


def _joined(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def expand_runs(spark: SparkSession, roots: list[str], levels: list[int]) -> DataFrame:
    """(run_name, folder, level) of every leaf with verdicts; a shard is named <run>__<shard>. Two leaves of one name are an error."""
    tables = []
    for root, level in zip(roots, levels, strict=True):
        name = F.concat_ws("__", F.lit(_name(root)), "shard")
        folder = F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(F.concat("shard", F.lit("/")), F.lit("")), "kernels")
        tables.append(leaves(spark, root).where("has_eval").select(name.alias("run_name"), folder.alias("folder"), F.lit(level).alias("level")))
    return require_unique(_joined(tables), ["run_name"], "run name")


def units(spark: SparkSession, roots: list[str], max_shards: int | None = None) -> DataFrame:
    """(run_name, shard, attempts, verdicts, skipped) of every shard, the first ``max_shards`` by name; ``skipped`` says which file is missing (null: none). Runs of one name, or without shards, are errors."""
    names = [_name(r) for r in roots]
    if len(set(names)) < len(names):
        raise ValueError(f"runs share a name: {sorted(names)}")
    tables = []
    for root in roots:
        d = leaves(spark, root).where("shard IS NOT NULL")
        if d.isEmpty():
            raise FileNotFoundError(f"no shards in {root}")
        if max_shards is not None:
            d = d.orderBy("shard").limit(max_shards)
        base = F.concat(F.lit(root.rstrip("/") + "/"), "shard", F.lit("/"))
        skipped = F.when(~F.col("has_attempts"), "no_attempts").when(~F.col("has_eval"), "no_eval_results")
        tables.append(d.select(F.lit(_name(root)).alias("run_name"), "shard", F.concat(base, "traces", F.lit(ATTEMPTS)).alias("attempts"), F.concat(base, "kernels", F.lit(EVAL)).alias("verdicts"), skipped.alias("skipped")))
    return _joined(tables)


def part_name(run_name: Column, shard: Column) -> Column:
    return F.concat(run_name, F.lit("__"), shard, F.lit(".jsonl"))


def part_run(part: Column) -> Column:
    """The run of a part's name: what stands before the last ``__``."""
    return F.regexp_extract(part, r"^(.*)__", 1)


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Flat ``key: value`` lines of a settings file; comments, nested and list lines are left out."""
    out = {}
    for row in spark.read.text(path).collect():  # a settings file: tens of lines
        line = row[0].split("#", 1)[0].rstrip()
        if line and ":" in line and line[0] not in " -\t":
            key, _, value = line.partition(":")
            out[key.strip()] = value.strip().strip("'\"")
    return out


def load_run(spark: SparkSession, root: str) -> dict:
    """run_name, level, model, backend and num_samples of a run, its level by settings or, failing that, by name."""
    has = not spark.read.format("binaryFile").option("pathGlobFilter", CONFIG).load(root).select("path").isEmpty()
    s = settings(spark, f"{root.rstrip('/')}/{CONFIG}") if has else {}
    level = s.get("pseudo_level") or s.get("level") or ""
    if not level.isdigit():
        found = re.search(r"level(\d+)", _name(root))
        if not found:
            raise ValueError(f"the level of {root} is unknown")
        level = found.group(1)
    n = s.get("num_samples") or ""
    return {"run_name": s.get("run_name") or _name(root), "level": int(level), "model": s.get("model"), "backend": s.get("backend"), "num_samples": int(n) if n.isdigit() else None}


def samples(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Every verdict of a run with the name of its kernel file, in order of problem and sample; the first ``limit``."""
    info = load_run(spark, root)
    v = readers.verdicts(spark, f"{root.rstrip('/')}/{EVAL}").where("sample_id IS NOT NULL")
    d = v.select(
        F.lit(info["run_name"]).alias("run_name"),
        F.lit(info["level"]).alias("level"),
        "problem_id",
        "sample_id",
        F.format_string(f"level_{info['level']}_problem_%d_sample_%d_kernel.py", "problem_id", "sample_id").alias("file"),
        F.coalesce("compiled", F.lit(False)).alias("compiled"),
        F.coalesce("correctness", F.lit(False)).alias("correct"),
        "runtime",
        F.col("runtime_stats.min").alias("runtime_min"),
        F.col("metadata.hardware").alias("hardware"),
        F.col("metadata.runtime_error_name").alias("error_name"),
    )
    return d if limit is None else d.orderBy("problem_id", "sample_id").limit(limit)


def kernel_names(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(level, problem_id, sample_id, path) of a run's kernel files in numeric order, the first ``limit``; nothing is read."""
    f = listing(spark, root, "*_kernel.py").where(F.col("rel").rlike(f"^{KERNEL}"))
    f = f.select(*(F.regexp_extract("rel", KERNEL, i).cast("long").alias(c) for i, c in enumerate(("level", "problem_id", "sample_id"), 1)), "path")
    f = f.orderBy("level", "problem_id", "sample_id")
    return f if limit is None else f.limit(limit)


def references(spark: SparkSession, root: str) -> DataFrame:
    """(problem_id, name, path) of the <id>_<Name>.py files of a level folder; two files of one id, or none at all, are errors."""
    f = listing(spark, root, "*.py").where(F.col("rel").rlike(r"^\d+_[^/]*\.py$")).select(F.regexp_extract("rel", r"^(\d+)_", 1).cast("long").alias("problem_id"), F.col("rel").alias("name"), "path")
    if f.isEmpty():
        raise ValueError(f"{root} holds no reference files")
    return require_unique(f, ["problem_id"], "reference")


def local_problems(spark: SparkSession, root: str, level: int, spec: str | None = None, max_chars: int = 24_000) -> DataFrame:
    """(level, problem_id, name, source, fate) of the references asked for by id (all without ``spec``): read, missing, or too_long (source null)."""
    ref = references(spark, root)
    text = spark.read.text(root, wholetext=True, pathGlobFilter="*.py").select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("source"))
    d = ref.select("problem_id", "name").join(text, "name")
    if spec is not None:
        wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(parse_int_spec(spec))], "problem_id long")
        d = wanted.join(d, "problem_id", "left")
    long = F.length("source") > max_chars
    return d.select(F.lit(level).alias("level"), "problem_id", "name", F.when(~long, F.col("source")).alias("source"), F.when(F.col("source").isNull(), "missing").when(long, "too_long").otherwise("read").alias("fate"))


def indexed_problems(rows: DataFrame, level: int, spec: str | None = None, max_chars: int | None = None, index: str = "index") -> DataFrame:
    """(level, problem_id, name, source) of a dataset's rows, chosen by place (all without ``spec``); the id is the number that a name starts with, or the place."""
    if spec is not None:
        rows = rows.where(F.col(index).isin(parse_int_spec(spec)))
    if max_chars is not None:
        rows = rows.where(F.length("code") <= max_chars)
    name = F.coalesce("name", F.format_string("problem_%04d.py", F.col(index)))
    lead = F.nullif(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^(\d+)", 1), F.lit(""))
    return rows.select(F.lit(level).alias("level"), F.coalesce(lead.cast("long"), F.col(index).cast("long")).alias("problem_id"), name.alias("name"), F.col("code").alias("source"))


def load_problems(spark: SparkSession, dataset: str | None = None, root: str | None = None, level: int = 1, spec: str | None = None, max_chars: int = 24_000) -> DataFrame:
    """Problems from a level folder, or from a dataset (Parquet: index, name, code); just one of the two."""
    if (dataset is None) == (root is None):
        raise ValueError("problems come from a folder or from a dataset")
    if root is not None:
        return local_problems(spark, root, level, spec, max_chars).where("fate = 'read'").drop("fate")
    return indexed_problems(spark.read.parquet(dataset), level, spec, max_chars)


def eval_shards(spark: SparkSession, root: str, run_name: str) -> DataFrame:
    """Verdicts of all folders <run_name>_s<number>; a folder without verdicts, two verdicts of one sample, or no folder are errors."""
    f = listing(spark, root).select(F.regexp_extract("rel", rf"^({re.escape(run_name)}_s\d+)/", 1).alias("folder"), F.col("rel").endswith("/" + EVAL).alias("graded")).where("folder <> ''")
    folders = [(r["folder"], r["graded"]) for r in f.groupBy("folder").agg(F.bool_or("graded").alias("graded")).orderBy("folder").collect()]  # tens of shards
    if not folders:
        raise FileNotFoundError(f"no {run_name}_s<number> under {root}")
    late = [x for x, graded in folders if not graded]
    if late:
        raise FileNotFoundError(f"{late[0]} has not been evaluated")
    tables = [readers.verdicts(spark, f"{root.rstrip('/')}/{x}/{EVAL}").withColumn("folder", F.lit(x)) for x, _ in folders]
    return require_unique(_joined(tables), ["problem_id", "sample_id"], "verdict of two shards")


def alternatives(pattern: str) -> list[str]:
    """a{x,y}b as [axb, ayb], for every brace."""
    pieces = re.split(r"\{([^{}]*)\}", pattern)
    return ["".join(x) for x in itertools.product(*(p.split(",") if i % 2 else [p] for i, p in enumerate(pieces)))]


def seen_by_scorer(spark: SparkSession, pattern: str) -> DataFrame:
    """(run_name, problem_id, sample_id) of all candidates of a scorer's training lists; a pattern without files is an error."""
    rows = spark.read.schema("problem_id long, candidates array<struct<run_name:string,sample_id:long>>").json(alternatives(pattern))
    out = rows.select("problem_id", F.explode("candidates").alias("c")).select("c.run_name", "problem_id", "c.sample_id").distinct()
    if not rows.inputFiles():
        raise FileNotFoundError(pattern)
    return out


def findings(spark: SparkSession, path: str) -> DataFrame:
    """The last report of each (level, problem, sample) of a scan's JSON lines, by place in the file; rows without a full key drop out."""
    schema = "level long, problem_id long, sample_id long, path string, parse_status string, summary map<string,string>"
    key = ["level", "problem_id", "sample_id"]
    d = spark.read.schema(schema).json(path).withColumn("i", F.monotonically_increasing_id()).dropna(subset=key)
    return d.groupBy(*key).agg(F.max_by(F.struct("path", "parse_status", "summary"), "i").alias("x")).select(*key, "x.*")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(stem, token_ids, topk_ids, topk_lp, sampled_lp, sampled_rank, seg, meta) of the .npz files under a folder, read file by file on the executors; nothing in them is unpickled."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("stem"), "content")

    def load(frames):
        import io

        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for stem, content in zip(pdf["stem"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    out.append({"stem": stem, "meta": str(z["meta"])} | {k: z[k].tolist() for k in ("token_ids", "topk_ids", "topk_lp", "sampled_lp", "sampled_rank", "seg")})
            yield pd.DataFrame(out, columns=["stem", "token_ids", "topk_ids", "topk_lp", "sampled_lp", "sampled_rank", "seg", "meta"])

    return f.mapInPandas(load, "stem string, token_ids array<long>, topk_ids array<array<long>>, topk_lp array<array<double>>, sampled_lp array<double>, sampled_rank array<long>, seg array<int>, meta string")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(sha, system_prompt) from the side table, a JSON map."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("sha", "system_prompt"))


def sources(rows: DataFrame, side: DataFrame) -> DataFrame:
    """``rows`` with their system prompt; a sha that the side table lacks is an error."""
    lost = rows.select(F.col("system_prompt_sha1").alias("sha")).distinct().join(side, "sha", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"system prompt {lost[0][0]} is not in the side table")
    return rows.join(side.withColumnRenamed("sha", "system_prompt_sha1"), "system_prompt_sha1")


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """(level, problem_id, split) from the JSON map "level:problem" to split."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "split"))
    return d.select(F.split_part("k", F.lit(":"), F.lit(1)).cast("long").alias("level"), F.split_part("k", F.lit(":"), F.lit(2)).cast("long").alias("problem_id"), "split")


def eval_run_name(path: str) -> str:
    """What follows the last folder named runs, or the folder's own name."""
    parts = [p for p in path.split("/") if p]
    if "runs" in parts[:-1]:
        return "/".join(parts[len(parts) - parts[::-1].index("runs") :])
    return parts[-1]


def done_slots(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id, sample_id) that a journal of JSON lines names."""
    return spark.read.schema("problem_id long, sample_id long").json(path).distinct()


def check_regime(want: dict, got: dict, what: str) -> None:
    """An error that names the settings in which a run differs from what a campaign asks for."""
    moved = {k: (v, got.get(k)) for k, v in want.items() if str(got.get(k)) != str(v)}
    if moved:
        raise ValueError(f"{what} was generated with other settings: {json.dumps(moved)}")
