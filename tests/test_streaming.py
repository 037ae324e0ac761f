"""Incremental scoring: each text once, parts that a rerun replaces, restarts."""

import os

from pyspark.sql import functions as F

from tallyloom.streaming import scoring as G

SCHEMA = "kind string, id string, level int, problem_id long, code string"


def score(d):
    return d.withColumn("orm_score", F.length("code").cast("double"))


def feed(spark, folder, name, rows):
    d = spark.createDataFrame([("rollout", i, 1, 1, c) for i, c in rows], SCHEMA).withColumn("code_sha1", G.text_sha(F.col("code")))
    d.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return d.schema


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def parts(spark, out):
    return sorted((r["batch"], r["code_sha1"]) for r in G.committed(spark, out, G.SCORES).collect())


def test_restarts_score_each_text_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = feed(spark, src, "a", [("r1", "aa"), ("r2", "bbb"), ("r3", "aa"), ("r4", None)])
    assert G.score_stream(stream(spark, src, schema), out, ck, score) == [0]
    feed(spark, src, "b", [("r5", "bbb"), ("r6", "cccc"), ("r1", "bbb")])
    assert G.score_stream(stream(spark, src, schema), out, ck, score) == [1]
    assert G.score_stream(stream(spark, src, schema), out, ck, score) == []
    held = parts(spark, out)
    assert [b for b, _ in held] == [0, 0, 0, 1] and len({s for _, s in held}) == 4
    got = {r["id"]: r["orm_score"] for r in G.scored_items(spark, out).collect()}
    assert got == {"r1": 3.0, "r2": 3.0, "r3": 2.0, "r4": None, "r5": 3.0, "r6": 4.0}
    # a batch that runs again, as after a crash before its offset was committed, makes the same part
    again = spark.read.schema(schema).parquet(f"{src}/b")
    G.score_batch(again, 1, out, score)
    assert parts(spark, out) == held and G.scored_items(spark, out).count() == 6


def test_unfinished_parts_do_not_count(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = feed(spark, src, "a", [("r1", "aa"), ("r2", "bbb")])
    feed(spark, src, "b", [("r3", "aa"), ("r4", "dd")])

    def dies(d):
        raise RuntimeError("killed")

    for how in (dies, score):
        try:
            ran = G.score_stream(stream(spark, src, schema), out, ck, how)
        except Exception:  # noqa: BLE001 - the first run is meant to die
            assert G.committed(spark, out, G.SCORES) is None
    assert ran == [0, 1] and len(parts(spark, out)) == 3
    os.remove(tmp_path / "out" / "scores" / "batch=1" / "_SUCCESS")
    assert {b for b, _ in parts(spark, out)} == {0}
    G.score_batch(spark.read.schema(schema).parquet(f"{src}/b"), 1, out, score)
    assert len(parts(spark, out)) == 3
    batch = spark.read.schema(schema).parquet(f"{src}/a", f"{src}/b")
    want = {r["id"]: r["orm_score"] for r in batch.join(score(batch.select("code_sha1", "code").distinct()).select("code_sha1", "orm_score"), "code_sha1").collect()}
    assert {r["id"]: r["orm_score"] for r in G.scored_items(spark, out).collect()} == want


def test_items_of_both_kinds(spark):
    """Anchors are taken out of the raw text, rollouts keep the code that they came with; a rollout without a prefix has no place."""
    a = G.anchor_items(spark.createDataFrame([("run", "s0", "x", 2, 5, "Plan\n```python\nx = 1\n```\n")], "run_name string, shard string, stem string, level int, problem_id long, raw string")).first()
    assert (a["kind"], a["id"], a["code"]) == ("anchor", "run__s0__x", "x = 1")
    rollouts = spark.createDataFrame([("q1", "p1", "```\ny\n```", None), ("q2", "p9", "z", None)], "rollout_id string, prefix_id string, code string, code_sha1 string")
    r = G.rollout_items(rollouts, spark.createDataFrame([("p1", 3, 7)], "prefix_id string, level int, problem_id long")).collect()
    assert [(x["id"], x["level"], x["problem_id"], x["code"]) for x in r] == [("q1", 3, 7, "```\ny\n```")] and r[0]["code_sha1"] is not None
