"""The driver's star schema read as candidates, verdicts, scores and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts at a time. Larger tables are dealt over more partitions than Spark makes of them, so that a task's memory does not grow with them.
TASK_ROWS = 500_000
#: How many times as many a task joins, as these pass through it. Fewer partitions also keep the tasks that read files from sorting their rows: Spark sorts what it deals over more than 200.
PASSING = 3


def dealer(rows: int, most: int, usual: int):
    """A function that deals a table of ``rows`` by a key over partitions of ``most`` rows; where the ``usual`` number of partitions is enough, it leaves the table as it is."""
    n = -(-rows // most)
    return (lambda d, key: d.repartition(n, key)) if n > usual else (lambda d, key: d)


def candidates(spark: SparkSession, sf_dir: str, priced: bool = True) -> DataFrame:
    """A row for each attempt: problem key, sample_id, verdict, times, baseline and two scores. The rows of a problem come out together, so that grouping by problem needs no shuffle. Without baselines and what follows from them (``priced`` false), attempts are the same rows and move once."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows, usual = li.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = dealer(rows, PASSING * TASK_ROWS, usual)
    # partitions that Spark makes itself are merged again by bytes, down to one for each core
    gather = dealer(rows, TASK_ROWS if priced else PASSING * TASK_ROWS, min(usual, spark.sparkContext.defaultParallelism))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    # baselines first: attempts are numbered over the joined rows, as in SQL, and stay where their problem is
    if priced:
        base = deal(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("base_mean")), "l_partkey")
        dealt = deal(li, "l_partkey")
        joined = dealt.join(base if dealt is li else base.hint("shuffle_hash"), "l_partkey", "left")
    else:
        # only how often its part stands in the table makes an attempt's rows; parts that stand twice are few or none, so Spark sends them to the attempts
        often = written(part.groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.count(F.lit(1)).cast("int").alias("often")).where("often > 1"), "parts")
        joined = li.join(often, "l_partkey", "left").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("often", F.lit(1)))))
    c = gather(joined.withColumnRenamed("l_orderkey", "problem_id"), "problem_id")
    c = c.withColumn("sample_id", F.row_number().over(Window.partitionBy("problem_id").orderBy(*(F.col(k).asc_nulls_last() for k in order))) - 1)
    c = c.select(
        (F.col("problem_id") % 3 + 1).alias("level"),
        "problem_id",
        "sample_id",
        F.col("l_linestatus").alias("run_name"),
        F.col("l_partkey").alias("part_id"),
        (F.col("l_returnflag") != "N").alias("compiled"),
        (F.col("l_returnflag") == "A").alias("correct"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("runtime"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).alias("runtime_min"),
        F.log(1 + F.col("l_extendedprice")).alias("orm"),
        (F.col("l_discount") * 10 - F.col("l_tax") * 5).alias("prm"),
        (F.col("l_linenumber") / 8.0).alias("rel_depth"),
        F.col("l_linenumber").alias("line"),
        *(["base_mean", (0.9 * F.col("base_mean")).alias("base_min")] if priced else []),
    )
    finish = F.when(F.col("line") == 7, "length").when(F.col("line") != 6, "stop")
    c = c.withColumn("trace", F.struct(F.lit(1).alias("passes"), F.lit(None).cast("string").alias("plan_finish_reason"), finish.alias("code_finish_reason")))
    c = c.withColumn("label", L.label(F.col("compiled"), F.col("correct")))
    return c.withColumn("speedup", L.speedup(F.col("correct"), F.col("runtime"), F.col("base_mean"))) if priced else c


#: The same view for DuckDB.
CANDIDATES_SQL = """
candidates AS (
  SELECT *, CASE WHEN label = 1 AND runtime > 0 AND base_mean > 0 THEN base_mean / runtime END AS speedup FROM (
    SELECT l_orderkey % 3 + 1 AS level, l_orderkey AS problem_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS sample_id,
      l_linestatus AS run_name, l_partkey AS part_id, l_returnflag <> 'N' AS compiled, l_returnflag = 'A' AS correct, (l_returnflag = 'A')::INT AS label,
      l_extendedprice / l_quantity AS runtime, l_extendedprice / l_quantity * (1 - l_discount) AS runtime_min, ln(1 + l_extendedprice) AS orm, l_discount * 10 - l_tax * 5 AS prm,
      l_linenumber / 8.0::DOUBLE AS rel_depth, l_linenumber AS line, p_retailprice AS base_mean, 0.9::DOUBLE * p_retailprice AS base_min,
      CASE WHEN l_linenumber = 7 THEN 'length' WHEN l_linenumber <> 6 THEN 'stop' END AS finish
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey))"""


def target_sql(s: str = "speedup", lo: float = 0.2, hi: float = 4.0, quant: float = 0.0) -> str:
    p = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (log2({s}) - log2({lo}::DOUBLE)) / (log2({hi}::DOUBLE) - log2({lo}::DOUBLE))))"
    if quant:
        p = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, round_even({p} / {quant}::DOUBLE, 0) * {quant}::DOUBLE))"
    return f"CASE WHEN label = 0 THEN 0.0::DOUBLE WHEN {s} IS NOT NULL THEN (1 + {p}) / 2 END"


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as prefixes: a list is a customer's orders at one of two cuts."""
    o = table(spark, sf_dir, "orders")
    p = o.select(
        F.col("o_orderkey").alias("prefix_id"),
        F.concat(F.lit("run"), (F.col("o_custkey") % 2).cast("string")).alias("run_name"),
        (F.col("o_custkey") % 3 + 1).alias("level"),
        F.col("o_custkey").alias("problem_id"),
        (F.col("o_orderkey") % 2).cast("int").alias("cut_index"),
        ((F.col("o_orderkey") % 97) / 97.0).alias("rel_depth"),
        F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_custkey") % 10 == 0, "test").when(F.col("o_custkey") % 10 <= 2, "val").otherwise("train").alias("split"),
    )
    return p.withColumn("list_key", F.concat_ws(":", "run_name", F.col("level").cast("string"), F.col("problem_id").cast("string"), F.col("cut_index").cast("string")))


#: Ids that a prefix has for its rollouts; those of a prefix with more rollouts run on into the next one's.
ROLLOUT_IDS = 100


def rollouts(spark: SparkSession, sf_dir: str, priced: bool = True) -> DataFrame:
    """Lineitems as the rollouts of a prefix (their order), with a verdict, two lengths and (``priced``) a baseline and a target. The rollouts of a prefix come out together."""
    c = candidates(spark, sf_dir, priced)
    if priced:
        c = c.withColumn("target", L.target(F.col("label"), F.col("speedup")))
    return c.select(
        F.col("problem_id").alias("prefix_id"),
        (F.col("problem_id") * ROLLOUT_IDS + F.col("sample_id")).alias("rollout_id"),
        "sample_id",
        L.truncation_state(F.col("trace")).alias("truncation"),
        "compiled",
        "correct",
        "label",
        "runtime",
        *(["base_mean", "speedup", "target"] if priced else []),
        F.col("orm").alias("score"),
        (F.col("part_id") % 500).alias("n_gen_tokens"),
        (F.col("part_id") % 2000).alias("n_tokens"),
    )


#: The same for DuckDB, with the values of prefixes of two finished, graded rollouts or more, and their lists.
CAMPAIGN_SQL = f"""{CANDIDATES_SQL},
prefixes AS (SELECT *, run_name || ':' || level || ':' || problem_id || ':' || cut_index AS list_key FROM (
  SELECT o_orderkey AS prefix_id, 'run' || (o_custkey % 2) AS run_name, o_custkey % 3 + 1 AS level, o_custkey AS problem_id, (o_orderkey % 2)::INT AS cut_index,
    (o_orderkey % 97) / 97.0::DOUBLE AS rel_depth, o_orderpriority AS source, CASE WHEN o_custkey % 10 = 0 THEN 'test' WHEN o_custkey % 10 <= 2 THEN 'val' ELSE 'train' END AS split FROM orders)),
rollouts AS (SELECT problem_id AS prefix_id, problem_id * 100 + sample_id AS rollout_id, sample_id, CASE WHEN finish IS NULL THEN 'unknown' WHEN finish = 'stop' THEN 'ok' ELSE 'truncated' END AS truncation,
  compiled, correct, label, runtime, base_mean, speedup, {target_sql()} AS target, orm AS score, part_id % 500 AS n_gen_tokens, part_id % 2000 AS n_tokens FROM candidates),
vals AS (SELECT prefix_id, count(*) AS n_rollouts, avg(target) AS v_graded, avg(score) AS score FROM rollouts WHERE truncation = 'ok' AND target IS NOT NULL GROUP BY prefix_id HAVING count(*) >= 2),
members AS (SELECT p.*, v.n_rollouts, v.v_graded, v.score, round(2 * v.v_graded, 6) AS rel FROM prefixes p JOIN vals v USING (prefix_id)),
fates AS (SELECT list_key, any_value(split) AS split, any_value(level) AS level, any_value(problem_id) AS problem_id, round(avg(rel_depth), 12) AS rel_depth_mean, count(*) AS n_items, (max(rel) - min(rel)) / 2 AS spread,
  CASE WHEN any_value(split) = 'test' THEN 'other_split' WHEN count(*) < 2 THEN 'too_small' WHEN min(rel) = max(rel) THEN 'all_equal' ELSE 'built' END AS fate FROM members GROUP BY list_key)"""
