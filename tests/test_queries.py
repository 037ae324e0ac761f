"""Every query of the registry against its DuckDB counterpart, and those without one for shape and reruns."""

import hashlib
import itertools
import math
import os
import re

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tallyloom.operators import build as B
from tallyloom.plans import queries as Q
from tallyloom.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    a, b = (sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in QUERIES and __spark_entry__.entry(spark).count() > 0


def test_sibling_lcp_takes_all_documents(spark, tmp_path):
    """Every pair of a source counts, whatever the ids; null and repeated ids pair as the join a.doc_id < b.doc_id has them."""
    rows = [(1, "s", "abcde"), (2, "s", "abcdx"), (3, "s", "b"), (7, "s", "abz"), (8, "u", "x" * 300), (9, "u", "x" * 299 + "y"), (10, "v", "one"), (11, "w", ""), (12, "w", "q"), (13, "z", None), (14, "z", "only")]
    rows += [(20, "r", "same text"), (20, "r", "same text"), (21, "r", "same"), (None, "r", "same text"), (22, None, "k"), (23, None, "k"), (30, "e", "\u00e9\U0001f600a"), (31, "e", "\u00e9\U0001f600b")]
    rows += [(100 + i, "m", "m" * i) for i in range(1, 258, 3)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for (i, s, x), (j, u, y) in itertools.permutations(rows, 2):
        if s is not None and s == u and None not in (i, j, x, y) and i < j:
            n, best = want.get(s, (0, 0))
            want[s] = n + 1, max(best, len(os.path.commonprefix([x[:256], y[:256]])))
    got = QUERIES["sibling_lcp"](spark, str(tmp_path))
    assert {r["source"]: (r["n"], r["longest"]) for r in got.collect()} == want


def null_of(key, items, rounds, seed):
    """Spreads of the null of a list {item: its scores}, drawn by the same hashes."""
    pool = sorted(x for s in items.values() for x in s)
    base = int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16)

    def u(r, place, k):
        x = (base + r * 2654435769 + (place * 65536 + k) * 40503) % 2**32
        for _ in range(2):
            x = (x ^ x >> 16) * 73244475 % 2**32
        return (x ^ x >> 16) / 2**32

    means = [[sum(pool[int(u(r, p, k) * len(pool))] for k in range(len(items[i]))) / len(items[i]) for p, i in enumerate(sorted(items))] for r in range(rounds)]
    return [max(m) - min(m) for m in means]


def test_draws_of_a_list_are_even_and_apart():
    """Means of draws over rounds and places are those of the uniform, and two places of one list do not move together."""
    import numpy as np

    d = np.array([[[(lambda x: x / 2**32)(_mix(s, r, p)) for p in (0, 65536, 131072, 1)] for r in range(200)] for s in range(0, 2**32, 2**32 // 50 + 7)])
    assert abs(d.mean() - 0.5) < 0.01 and np.abs(np.corrcoef(d.reshape(-1, 4).T) - np.eye(4)).max() < 0.05
    assert abs(np.corrcoef(d[:, :-1].ravel(), d[:, 1:].ravel())[0, 1]) < 0.05


def _mix(s, r, place):
    x = (s + r * 2654435769 + place * 40503) % 2**32
    for _ in range(2):
        x = (x ^ x >> 16) * 73244475 % 2**32
    return x ^ x >> 16


def test_null_bootstrap_takes_all_lists(spark, sf):
    """Every problem with a target has its null, of 200 replicates, and q95 is the value at place int(0.95 n) of the sorted spreads."""
    lists = {}
    for r in Q._anchors(spark, sf).collect():
        lists.setdefault((r["level"], r["problem_id"]), {})[r["sample_id"]] = [r["target"]]
    got = {(r["level"], r["problem_id"]): (r["q95"], r["mean"]) for r in QUERIES["null_bootstrap"](spark, sf).collect()}
    assert got.keys() == lists.keys() and any(p % 20 for _, p in got)
    for key in sorted(lists)[::25]:
        x = null_of(key, lists[key], 200, 11)
        assert got[key] == pytest.approx((sorted(x)[190], sum(x) / 200))


def test_null_spreads(spark):
    """Items of several scores redraw as many as they have; the spread is on the scale of the scores."""
    rows = [(1, "a", 0.0), (1, "a", 1.0), (1, "b", 0.25), (1, "c", 0.5), (1, "c", 0.75), (1, "c", 1.0), (2, "a", 0.5)]
    got = {r["p"]: r["spreads"] for r in B.null_spreads(spark.createDataFrame(rows, "p long, i string, v double"), ["p"], "i", "v", 7, 3).collect()}
    assert got[1] == pytest.approx(null_of((1,), {"a": [0.0, 1.0], "b": [0.25], "c": [0.5, 0.75, 1.0]}, 7, 3)) and got[2] == [0.0] * 7
    d = spark.createDataFrame([([3.0, 1.0, 2.0],), ([5.0],)], "x array<double>")
    assert [r[0] for r in d.select(B.quantile(d.x, 0.95)).collect()] == [3.0, 5.0]


def test_shard_plan_takes_real_keys(spark, sf):
    """The plan of the query is the driver loop's over every problem of lineitem, and so at other sizes."""
    li = Q.table(spark, sf, "lineitem")
    counts = [(r[0], r[1]) for r in li.groupBy("l_orderkey").count().collect()]
    cols = ["shard", "first", "last", "n", "max_samples"]
    assert [tuple(r) for r in QUERIES["shard_plan"](spark, sf).collect()] == [tuple(s[c] for c in cols) for s in B.plan_shards(counts, 8)]
    few = [(1, 10), (2, 1), (5000, 1), (9000, 1), (-3, 2)]
    d = spark.createDataFrame([(k,) for k, n in few for _ in range(n)], "p long")
    for n in (1, 3, 5, 9):
        assert [tuple(r) for r in B.shard_plan(d, "p", n).collect()] == [tuple(s[c] for c in cols) for s in B.plan_shards(few, n)]
    assert B.shard_plan(d.limit(0), "p", 3).count() == 0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.RandomState(1)
    for x in (rng.randn(3000) ** 3, np.repeat([1.0, 2.0, 5.0], [700, 200, 100]), np.array([4.0])):
        d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
        for buckets in (1024, 7):
            assert np.allclose(B.quantiles(d, "x", qs, buckets), np.quantile(x, qs))
    wide = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, 1e300, -5.0, float("inf"), float("nan"))], "x double")
    assert B.quantiles(wide, "x", [0.0, 0.25, 0.5, 1.0]) == [float("-inf"), -5.0, 1.0, float("inf")]
    assert B.quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == []


def test_lists_of_one_positive_keep_the_fastest(spark):
    rows = [(1, 1, i, int(i < 4), 1.0 + i if i < 4 else None) for i in range(7)]
    c = spark.createDataFrame(rows, "level long, problem_id long, sample_id long, label int, speedup double")
    got = {r["sample_id"]: r["rel"] for r in B.ranked_lists(c, max_pos=1, max_neg=2).collect()}
    assert [i for i in got if i < 4] == [3] and len(got) == 3


def test_two_level_ranks(spark):
    rows = [(None if i % 5 == 0 else i % 3, (i * 7919) % 10_000) for i in range(500)]
    d = B.two_level_rank(spark.createDataFrame(rows, "k int, v long"), ["k"], F.floor(F.col("v") / 64), ["v"], "r", "n")
    for k in (None, 0, 1, 2):
        mine = sorted(v for x, v in rows if x == k)
        got = sorted((r["r"], r["v"], r["n"]) for r in d.collect() if r["k"] == k)
        assert got == [(i + 1, v, len(mine)) for i, v in enumerate(mine)]


def test_rank_report_whatever_the_partitions(spark, sf):
    """Lists near a band's edge stay in their band, however the members of a list are dealt out."""
    from tallyloom.operators import campaign as C

    rows = [(i, "l" + str(i % 7), x) for i, x in enumerate([k / 97 for k in range(1, 97)] * 3)]
    d = spark.createDataFrame(rows, "i long, list_key string, rel_depth double")
    means = [sorted(map(tuple, d.repartition(n, "i").groupBy("list_key").agg(C.exact_mean("rel_depth").alias("m")).collect())) for n in (1, 4, 200)]
    assert means[0] == means[1] == means[2]
    halves = spark.createDataFrame([("a", x) for x in (0.1, 0.2, 0.7, 1.0)], "list_key string, rel_depth double")
    assert halves.groupBy("list_key").agg(C.exact_mean("rel_depth").alias("m")).first()["m"] == 0.5


def test_null_draws_are_no_rows(spark):
    """Draws stay in arrays: no plan unfolds and regroups them, which spilled; many lists at a time give what each gives alone."""
    rows = [(p, f"i{i}", (p * 7 + i * 3 + j) % 11 / 11) for p in range(40) for i in range(1 + p % 5) for j in range(1 + (p + i) % 4)] + [(99, "a", None)]
    null = B.null_spreads(spark.createDataFrame(rows, "p long, i string, v double"), ["p"], "i", "v", 50, 3)
    plan = null._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "sequence" not in plan
    got = {r["p"]: r["spreads"] for r in null.collect()}
    lists = {}
    for p, i, v in rows[:-1]:
        lists.setdefault(p, {}).setdefault(i, []).append(v)
    assert got.pop(99) == [] and got.keys() == lists.keys()
    for p, items in lists.items():
        assert got[p] == pytest.approx(null_of((p,), items, 50, 3))


def test_slots_read_their_rows_once(spark):
    """What makes the rows is not run again for the owners and for all rows."""
    d = spark.range(12).selectExpr("id % 2 AS p", "id AS rid", "'t' || id % 3 AS code")
    slots = B.dense_slots(d, ["p"], "code", "rid")
    assert "Range" not in slots._jdf.queryExecution().optimizedPlan().toString()
    assert {r["rid"]: (r["owner"], r["slot"]) for r in slots.where("p = 0").collect()} == {0: (0, 0), 2: (2, 1), 4: (4, 2), 6: (0, 0), 8: (2, 1), 10: (4, 2)}


def test_rank_report_reads_lists_once(spark, sf):
    """What a report says of lists is worked out in one row a list: no pair is a row, ties and items without a grade are told apart, and an empty report has its rows."""
    from tallyloom.operators import campaign as C

    rows = [("a", 1, 0.9, 1.0), ("a", 2, 0.9, 0.5), ("a", 3, 0.1, 1.5), ("a", 4, 0.5, None), ("b", 1, 0.2, 0.0), ("b", 2, 0.1, 0.0)]
    d = C.per_list_metrics(spark.createDataFrame(rows, "l string, k long, s double, r double"), ["l"], "k", "s", "r")
    got = {r["l"]: r for r in d.collect()}
    gain = lambda rels: sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(rels) if r is not None)
    assert (got["a"]["n_items"], got["a"]["pairs_total"], got["a"]["pairs_correct"]) == (4, 3, 0) and got["a"]["ndcg"] == pytest.approx(gain([1.0, 0.5, None, 1.5]) / gain([1.5, 1.0, 0.5]))
    assert (got["b"]["n_items"], got["b"]["pairs_total"], got["b"]["ndcg"]) == (2, 0, 0.0)
    with pytest.raises(KeyError, match="never scored"):
        C.per_list_metrics(spark.createDataFrame([("a", 1, None, 1.0)], "l string, k long, s double, r double"), ["l"], "k", "s", "r")
    report = C.rank_report(d.withColumn("depth", F.lit(0.2)), "depth", [0.1, 0.5, 0.9])
    assert [(r["band"], r["n_lists"], r["n_items"], r["ndcg"] is None) for r in report.orderBy(F.col("band").asc_nulls_last()).collect()] == [(0, 2, 6, False), (1, 0, 0, True), (None, 2, 6, False)]
    assert [tuple(r)[1:] for r in C.rank_report(d.limit(0).withColumn("depth", F.lit(0.2)), "depth", [0.1, 0.9]).collect()] == [(0, 0, 0, None, None, 0, 0)] * 2
    plan = QUERIES["rank_report"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "Union" not in plan and plan.count("Relation") == 2


@pytest.mark.parametrize("name", ["ranking_metrics", "graded_ndcg"])
def test_tasks_do_not_grow_with_attempts(spark, sf, monkeypatch, name):
    """More attempts come over more partitions, each problem in one of them; the rows and metrics stay the same."""
    from tallyloom.sources import adapters as A

    few = A.candidates(spark, sf)
    want = sorted(map(repr, few.collect()))
    n = len(want)
    monkeypatch.setattr(A, "TASK_ROWS", 100)
    many = A.candidates(spark, sf)
    assert few.rdd.getNumPartitions() <= 8 and many.rdd.getNumPartitions() == -(-n // 100)
    assert sorted(map(repr, many.collect())) == want
    assert many.select("problem_id", F.spark_partition_id().alias("p")).distinct().count() == many.select("problem_id").distinct().count()
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_merged_partitions_stay_bounded(spark, sf, monkeypatch):
    """Where Spark has more partitions than the attempts need, it merges them by bytes; a task still gets no more attempts than it should sort."""
    from tallyloom.sources import adapters as A

    want = sorted(map(repr, A.candidates(spark, sf).collect()))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(A, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        many = A.candidates(spark, sf)
        assert sorted(map(repr, many.collect())) == want
        assert max(r["count"] for r in many.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 1000
        assert_same(QUERIES["graded_ndcg"](spark, sf), ORACLES["graded_ndcg"], sf)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_files_are_read_without_sorting(spark, sf, monkeypatch):
    """Over 200 partitions Spark sorts all rows of a task that reads a file; attempts meet their baselines in fewer, then come over as many as they need."""
    from tallyloom.sources import adapters as A

    monkeypatch.setattr(A, "TASK_ROWS", 14)
    c = A.candidates(spark, sf)
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    dealt = {k: {int(n) for n in re.findall(rf"RepartitionByExpression \[{k}#\d+L?\], (\d+)", plan)} for k in ("l_partkey", "problem_id")}
    assert min(dealt["problem_id"]) > 400 and dealt["l_partkey"] and max(dealt["l_partkey"]) <= 200
    assert_same(QUERIES["graded_ndcg"](spark, sf), ORACLES["graded_ndcg"], sf)


def test_repeated_parts_are_numbered_as_in_sql(spark, tmp_path, sf):
    """Attempts are numbered over the rows joined with baselines: a part that stands twice makes two attempts, one without a price or a row makes one."""
    from oracle import duck

    from tallyloom.sources import adapters as A

    Q.table(spark, sf, "lineitem").where("l_orderkey < 60").write.parquet(str(tmp_path / "lineitem.parquet"))
    p = Q.table(spark, sf, "part").where("p_partkey % 5 > 0").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("p_retailprice"))
    p.unionByName(p.where("p_partkey % 3 = 0")).write.parquet(str(tmp_path / "part.parquet"))
    cols = ["problem_id", "sample_id", "line", "base_mean"]
    got = sorted(map(repr, (tuple(r) for r in A.candidates(spark, str(tmp_path)).select(*cols).collect())))
    want = duck(str(tmp_path)).sql(f"WITH {A.CANDIDATES_SQL} SELECT {', '.join(cols)} FROM candidates").fetchall()
    assert len({(r[0], r[2]) for r in want}) < len(want) and any(r[3] is None for r in want) and got == sorted(map(repr, want))


def _moved(spark, run):
    """Records that stages shuffled or wrote to files while ``run`` ran."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        seq = sc.statusStore().stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in (seq.apply(i) for i in range(seq.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["rollout_verdicts", "stage_counts"])
def test_rollouts_move_once(spark, sf, name):
    """A rollout is shuffled to its prefix and neither shuffled again nor written."""
    n = Q.table(spark, sf, "lineitem").count()
    assert n < _moved(spark, lambda: QUERIES[name](spark, sf).collect()) < 1.5 * n


@pytest.mark.parametrize("most", [0, 250])
def test_rollout_verdicts_of_odd_orders(spark, tmp_path, sf, most):
    """Repeated parts, missing keys, and an order of so many lines that its rollouts' ids run on into the next order's, as in SQL."""
    li = Q.table(spark, sf, "lineitem").where("l_orderkey < 60")
    odd = [li.where("l_orderkey % 9 = 0").withColumn("l_orderkey", F.lit(None).cast("long")), li.where("l_orderkey % 4 = 0").withColumn("l_partkey", F.lit(None).cast("long"))]
    if most:
        odd.append(spark.range(most).crossJoin(li.limit(1)).withColumns({"l_orderkey": F.lit(7).cast("long"), "l_partkey": F.col("id") % 90, "l_extendedprice": F.col("id") * 1.5}).select(li.columns))
    for d in odd:
        li = li.unionByName(d)
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    p = Q.table(spark, sf, "part").where("p_partkey % 5 > 0")
    p.unionByName(p.where("p_partkey % 3 = 0")).write.parquet(str(tmp_path / "part.parquet"))
    Q.table(spark, sf, "orders").write.parquet(str(tmp_path / "orders.parquet"))
    assert_same(QUERIES["rollout_verdicts"](spark, str(tmp_path)), ORACLES["rollout_verdicts"], str(tmp_path))


def test_shared_verdicts_are_those_of_the_join(spark):
    """Rollouts in one table get what the join of rollouts, slots and verdicts gives them; a rollout that was not staged is an error there."""
    from tallyloom.operators import campaign as C

    rows = [(1, 1, 10, "a", 1.0), (1, 1, 11, "b", 2.0), (1, 1, 12, "a", 3.0), (1, 2, 20, None, None), (1, 2, 21, None, 5.0), (2, 1, 30, "a", 6.0)]
    r = spark.createDataFrame(rows, "level int, problem_id int, rollout_id int, code string, runtime double")
    placed = B.problem_slots(r, Q.P, "code", "rollout_id")
    got = {x["rollout_id"]: (x["owner"], x["slot"], x["shared"], x["runtime"]) for x in C.shared_verdicts(placed, ["runtime"]).collect()}
    assert got == {10: (10, 0, False, 1.0), 11: (11, 1, False, 2.0), 12: (10, 0, True, 1.0), 20: (20, 0, False, None), 21: (20, 0, True, None), 30: (30, 0, False, 6.0)}
    slots = placed.select("rollout_id", "owner", "slot", "shared")
    joined = C.measured_rollouts(r.drop("runtime"), slots, placed.where("NOT shared").select(*Q.P, "slot", "runtime"))
    assert {x["rollout_id"]: (x["owner"], x["slot"], x["shared"], x["runtime"]) for x in joined.collect()} == got
    with pytest.raises(KeyError, match="never staged"):
        C.measured_rollouts(r.drop("runtime"), slots.where("rollout_id <> 12"), placed.select(*Q.P, "slot", "runtime"))
