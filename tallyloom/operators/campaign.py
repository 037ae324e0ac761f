"""A labelling campaign as tables: prefixes, rollouts, values, lists, anchors; its joins, ledgers, reports and acceptance checks.

Keys are columns named by the caller where they differ between tables; ``PROBLEM`` names a problem. Reports are one
pass each: counts and sums are partial aggregates, and what a report prints is a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.scratch import written
from .build import PROBLEM, expectations, quantile, quantiles, require_unique

#: Fixed values of the acceptance checks.
MAX_TRUNCATED_PCT, MAX_TOO_FEW_PCT, ALL_EQUAL_PCT, MIN_LISTS, MIN_VAL_LISTS, NULL_Q = 2.0, 5.0, (2.0, 10.0), 300, 60, 0.95


# labels and datasets


def anchor_target(c: DataFrame, stat: str = "speedup", **scale: float) -> Column:
    """0 for a wrong candidate, the graded speedup for a correct one, null where that cannot be graded (a drop, never a zero)."""
    s = F.col(stat)
    return F.when(~F.coalesce("correct", F.lit(False)), F.lit(0.0)).when(L.usable(s), L.graded_target(s, **scale))


def negatives(c: DataFrame, mode: str) -> DataFrame:
    """Rows of a dataset: all, or (compiled_wrong) without candidates that did not compile."""
    if mode not in ("all_negative", "compiled_wrong"):
        raise ValueError(f"negative mode {mode!r}")
    return c if mode == "all_negative" else c.where((F.col("label") == 1) | F.coalesce("compiled", F.lit(False)))


def dataset_rows(verdicts: DataFrame, problems: DataFrame, kernels: DataFrame, baselines: DataFrame, mode: str = "all_negative") -> DataFrame:
    """The dataset: verdicts of known problems with a staged kernel, and their two speedups over the baseline (mean by mean, min by min)."""
    key = [*PROBLEM, "sample_id"]
    d = verdicts.join(problems, PROBLEM).join(kernels, key).join(baselines, PROBLEM, "left")
    d = d.withColumn("label", L.label(F.col("compiled"), F.col("correct")))
    slow = L.dataset_speedup(F.col("correct"), F.col("runtime"), F.col("base_mean"))
    fast = F.when(slow.isNotNull() & (F.col("base_min") > 0) & (F.col("runtime_min") > 0), F.col("base_min") / F.col("runtime_min"))
    return negatives(d.withColumns({"speedup": slow, "speedup_min": fast}), mode)


def kept_cuts(rows: DataFrame, min_frac: float) -> DataFrame:
    """``rows`` with cuts (arrays of struct char, kind, index) from ``min_frac`` of the text on; rows without any left go."""
    d = rows.withColumn("cuts", F.filter("cuts", lambda c: c["char"] >= min_frac * F.length("raw")))
    return d.where(F.size("cuts") > 0)


def n_cuts_total(cuts: Column) -> Column:
    """Cuts of the whole completion: the last kept cut's index and one, as leading cuts may have been dropped."""
    return F.element_at(cuts, -1)["index"] + 1


def pos_weight(c: DataFrame) -> DataFrame:
    """One row: total, positive, negative and their ratio (1 without positives)."""
    pos, n = F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))
    return c.agg(n.alias("total"), pos.alias("positive"), (n - pos).alias("negative"), F.when(pos > 0, (n - pos) / pos).otherwise(1.0).alias("pos_weight"))


def two_way_split(problems: DataFrame, train: float = 0.9, seed: int = 0, stratify: list[str] | None = None) -> DataFrame:
    """train or val of each problem: the first round(train * n) of a stratum in the order of a hash are train."""
    if not 0 <= train <= 1:
        raise ValueError(f"a share of {train}")
    p = problems.select(*PROBLEM).distinct().withColumn("h", L.hash_order(seed, *map(F.col, PROBLEM)))
    w = Window.partitionBy(*(stratify or []))
    p = p.withColumns({"r": F.row_number().over(w.orderBy("h", *PROBLEM)), "n": F.count(F.lit(1)).over(w)})
    return p.select(*PROBLEM, F.when(F.col("r") <= F.bround(F.col("n") * train), "train").otherwise("val").alias("split"))


def in_split(rows: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Rows of the problems of one split; none is an error."""
    out = rows.join(splits.where(F.col("split") == split).select(*PROBLEM), PROBLEM, "left_semi")
    if out.isEmpty():
        raise ValueError(f"no rows for split {split!r}")
    return out


def rows_of_lists(lists: DataFrame, dataset: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The members of lists with their dataset rows' ``fields``; only cited rows and those columns are read. A member without a row is an error."""
    out = lists.join(dataset.select(*key, *fields, F.lit(True).alias("found")), key, "left")
    missing = out.where("found IS NULL").select(*key).limit(1).collect()
    if missing:
        raise KeyError(f"a list names a row that the dataset lacks: {missing[0].asDict()}")
    return out.drop("found")


def sampled_lists(lists: DataFrame, n: int, seed: int, key: str = "list_key") -> DataFrame:
    """``n`` lists by a hash of their key (all, if they are no more): the choice does not depend on the order of rows."""
    chosen = lists.select(key).distinct().orderBy(L.hash_order(seed, F.col(key)), key).limit(n)
    return lists.join(chosen, key, "left_semi")


# joins


def homes(prefixes: DataFrame) -> DataFrame:
    """(prefix_id, level, problem_id); an id that two prefixes share is an error."""
    return require_unique(prefixes.select("prefix_id", *PROBLEM), ["prefix_id"], "prefix")


def measured_rollouts(rollouts: DataFrame, placed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rollouts with the verdict of the slot in which they, or the copy they share, were run (null without one). A rollout without a slot is an error."""
    out = written(rollouts.join(placed, "rollout_id", "left"), "placed")  # read for the check and for the verdicts
    lost = out.where("owner IS NULL").select("rollout_id").limit(1).collect()
    if lost:
        raise KeyError(f"{lost[0][0]} was never staged")
    return out.join(verdicts, [*PROBLEM, "slot"], "left")


def shared_verdicts(placed: DataFrame, verdict: list[str]) -> DataFrame:
    """``measured_rollouts`` where rollouts have their owner, shared and own ``verdict`` columns in one table (``problem_slots``): a shared rollout's are those of the copy that was run."""
    run = F.max(F.when(~F.col("shared"), F.struct(*verdict))).over(Window.partitionBy(*PROBLEM, "owner"))
    return placed.withColumn("_run", run).withColumns({c: F.col("_run")[c] for c in verdict}).drop("_run")


def members(prefixes: DataFrame, values: DataFrame) -> DataFrame:
    """Values with the list, problem, split and depth of their prefix; a value without a prefix is an error."""
    own = [c for c in values.columns if c != "prefix_id"]
    m = values.join(prefixes.withColumn("_known", F.lit(True)), "prefix_id", "left").select(*prefixes.columns, *own, "_known")
    m = written(m, "members")  # read for the check, and by lists more than once
    lost = m.where("_known IS NULL").select("prefix_id").limit(1).collect()
    if lost:
        raise KeyError(f"{lost[0][0]} has a value but no prefix")
    return m.drop("_known")


def anchors(rows: DataFrame, scores: DataFrame, seen: DataFrame, stat: str = "speedup", **scale: float) -> DataFrame:
    """Scored anchors with target, orm_seen and ``fate``: kept, no_row or no_target. ``scores`` and ``rows`` share ``key``; a key that names two problems is an error."""
    r = rows.withColumn("target", anchor_target(rows, stat, **scale)).select("key", *(F.col(c).alias(f"row_{c}") for c in PROBLEM), "target", F.lit(True).alias("has_row"))
    d = scores.join(r, "key", "left").join(seen.select("key").distinct().withColumn("in_lists", F.lit(True)), "key", "left")
    wrong = d.where("row_level <> level OR row_problem_id <> problem_id").select("key").limit(1).collect()
    if wrong:
        raise ValueError(f"anchor {wrong[0][0]} is scored under another problem than its row's")
    fate = F.when(F.col("has_row").isNull(), "no_row").when(F.col("target").isNull(), "no_target").otherwise("kept")
    return d.withColumns({"orm_seen": F.coalesce("in_lists", F.lit(False)), "fate": fate}).drop("row_level", "row_problem_id", "has_row", "in_lists")


def anchor_ledger(a: DataFrame) -> DataFrame:
    kept = F.col("fate") == "kept"
    return a.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(F.col("fate") == "no_row").alias("no_row"),
        F.count_if(F.col("fate") == "no_target").alias("no_target"),
        F.count_if(kept & F.col("orm_seen")).alias("orm_seen"),
        F.count_if(kept & ~F.col("orm_seen")).alias("orm_unseen"),
        F.count_if(kept).alias("kept"),
        F.countDistinct(F.when(kept, F.struct(*PROBLEM))).alias("problems"),
    )


def leaked(lists: DataFrame, prefixes: DataFrame, split: str = "val") -> DataFrame:
    """Members of that split's lists whose prefix is unknown or of another split."""
    own = prefixes.select("prefix_id", F.col("split").alias("own"))
    return lists.where(F.col("split") == split).join(own, "prefix_id", "left").where(f"own IS NULL OR own <> '{split}'").drop("own")


def spanning(lists: DataFrame, prefixes: DataFrame, key: list[str]) -> DataFrame:
    """list_key of lists whose members differ in ``key`` (run, problem, cut) by their prefixes."""
    d = lists.select("list_key", "prefix_id").join(prefixes.select("prefix_id", F.struct(*key).alias("k")), "prefix_id")
    return d.groupBy("list_key").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("list_key")


def without_anchors(problems: DataFrame, offsets: DataFrame) -> DataFrame:
    """Problems of a campaign that have no offset."""
    return problems.select(*PROBLEM).distinct().join(offsets.select(*PROBLEM), PROBLEM, "left_anti")


def union_parts(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """All rows of several parts, by name; a key that two rows share is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return require_unique(out, key, "row of several parts")


# lists of prefixes


def in_window(depth: Column, lo: float, hi: float) -> Column:
    return (depth >= lo) & (depth <= hi)


def stratified(prefixes: DataFrame, lo: float, hi: float, min_size: int, max_size: int, seed: int) -> DataFrame:
    """Members of each list inside the depth window, ``max_size`` of them at most by a hash draw; lists of under ``min_size`` go. The window comes first, so a capped list has only members inside it."""
    p = prefixes.where(in_window(F.col("rel_depth"), lo, hi))
    w = Window.partitionBy("list_key")
    p = p.withColumns({"r": F.row_number().over(w.orderBy(L.hash_order(seed, F.col("list_key"), F.col("prefix_id")), "prefix_id")), "n": F.count(F.lit(1)).over(w)})
    return p.where((F.col("n") >= min_size) & (F.col("r") <= max_size)).drop("r", "n")


def exact_mean(column: str) -> Column:
    """Aggregate: a mean that does not depend on the order of rows, for what is compared with an edge: summed as decimals, to 12 places."""
    return F.round(F.sum(F.col(column).cast("decimal(24,15)")).cast("double") / F.count(column), 12)


def list_fates(m: DataFrame, min_size: int = 2, dead: DataFrame | None = None) -> DataFrame:
    """One row a list: what it is (run, problem, cut, split, source, mean depth, size, spread of rel) and ``fate``: built, or the first rule that drops it (other_split, dead_problem, too_small, all_equal). Members that mix runs, problems, cuts or label sources are an error."""
    one = ["run_name", *PROBLEM, "cut_index", "label_source"]
    g = m.groupBy("list_key").agg(
        *(F.min(c).alias(c) for c in one),
        *(F.max(c).alias(f"{c}_2") for c in one),
        F.min("split").alias("split"),
        F.min_by("source", "prefix_id").alias("source"),
        exact_mean("rel_depth").alias("rel_depth_mean"),
        F.count(F.lit(1)).alias("n_items"),
        F.min("rel").alias("lo"),
        F.max("rel").alias("hi"),
    )
    g = written(g, "lists")  # read for the check, for fates and for members of built lists
    mixed = g.where(" OR ".join(f"{c} <> {c}_2" for c in one)).select("list_key").limit(1).collect()
    if mixed:
        raise ValueError(f"list {mixed[0][0]} mixes runs, problems, cuts or label sources")
    if dead is not None:
        g = g.join(dead.select(*PROBLEM, F.lit(True).alias("is_dead")), PROBLEM, "left")
    rules = [("other_split", ~F.col("split").isin("train", "val")), ("dead_problem", F.col("is_dead") if dead is not None else F.lit(False)), ("too_small", F.col("n_items") < min_size), ("all_equal", F.col("lo") == F.col("hi"))]
    fate = F.coalesce(L.first_reason(*rules), F.lit("built"))
    return g.withColumns({"fate": fate, "spread": (F.col("hi") - F.col("lo")) / 2}).drop("lo", "hi", *(f"{c}_2" for c in one), *(["is_dead"] if dead is not None else []))


def lists_manifest(fates: DataFrame) -> DataFrame:
    """(split, fate, lists, items, two_item_lists)."""
    return fates.groupBy("split", "fate").agg(F.count(F.lit(1)).alias("lists"), F.sum("n_items").alias("items"), F.count_if(F.col("n_items") == 2).alias("two_item_lists"))


def size_histogram(fates: DataFrame) -> DataFrame:
    return fates.groupBy(F.col("n_items").alias("width")).agg(F.count(F.lit(1)).alias("n"))


# values and rollouts


def rollout_fates(rollouts: DataFrame, min_rollouts: int, by: str = "prefix_id") -> DataFrame:
    """(reason, n): what became of rollouts, and prefixes with too few of them left: the ledger of measured values. ``finish`` states come from ``truncation_state``; ``target`` is null where a verdict cannot be graded."""
    reason = L.first_reason(("truncated", F.col("truncation") == L.TRUNCATED), ("no_finish_reason", F.col("truncation") != L.OK), ("no_eval_entry", F.col("compiled").isNull()), ("no_runtime", F.col("target").isNull() & ~L.usable(F.col("runtime"))), ("no_baseline", F.col("target").isNull()))
    d = rollouts.withColumn("reason", F.coalesce(reason, F.lit("kept")))
    one = d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    few = d.groupBy(by).agg(F.count_if(F.col("reason") == "kept").alias("k")).where(F.col("k") < min_rollouts).agg(F.lit("too_few_rollouts").alias("reason"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(few)


def mean_lengths(rollouts: DataFrame, tokens: str, by: str = "prefix_id") -> DataFrame:
    """(prefix, mean_length) over rollouts that finished: those that were cut off all have the same length."""
    return rollouts.where((F.col("truncation") == L.OK) & F.col(tokens).isNotNull()).groupBy(by).agg(F.avg(tokens).alias("mean_length"))


def correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, r): Pearson's r, null under two pairs or where a side is constant."""
    d = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    varies = (F.count(F.lit(1)) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return d.agg(F.count(F.lit(1)).alias("n"), F.when(varies, F.corr(x, y)).alias("r"))


def stage_counts(slots: DataFrame) -> DataFrame:
    """One row: rollouts, staged (distinct slots), deduped, and the share of rollouts whose run another one had paid for."""
    n, shared = F.count(F.lit(1)), F.count_if("shared")
    return slots.agg(n.alias("rollouts"), (n - shared).alias("staged"), shared.alias("deduped"), L.percent(shared, n).alias("dedup_pct"))


def per_gpu_hour(evals: DataFrame, shards: DataFrame) -> DataFrame:
    """One row (evals, rate): evaluations for each GPU hour of the accounted shards (elapsed_s, gpus); no time at all is an error."""
    out = evals.agg(F.count(F.lit(1)).alias("evals")).crossJoin(F.broadcast(shards.agg(F.sum(F.col("elapsed_s") * F.col("gpus")).alias("s"))))  # one row each
    if out.where("s IS NULL OR s <= 0").limit(1).collect():
        raise ValueError("no GPU time is on record")
    return out.select("evals", (F.col("evals") * 3600.0 / F.col("s")).alias("rate"))


# reports


def target_dist(a: DataFrame, target: str = "target") -> DataFrame:
    """One row: n, share of zeros, mean and quartiles of the anchors' targets."""
    t = F.col(target)
    q = F.percentile(t, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # of anchors' targets: few distinct values, counted
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = a.where(t.isNotNull()).agg(F.count(F.lit(1)).alias("n"), zero(F.avg((t == 0).cast("double"))).alias("frac_zero"), zero(F.avg(t)).alias("mean"), q.alias("q"))
    return d.select("n", "frac_zero", "mean", *(zero(F.get("q", F.lit(i))).alias(f"p{p}") for i, p in enumerate((25, 50, 75))))


def calibration_error(pairs: DataFrame, measured: str, imputed: str, by: list[str] | None = None) -> DataFrame:
    """Mean absolute error of imputed values (null pairs left out), overall or for each slice, with its n."""
    d = pairs.where(F.col(measured).isNotNull() & F.col(imputed).isNotNull())
    return d.groupBy(*(by or [])).agg(F.avg(F.abs(F.col(imputed) - F.col(measured))).alias("cal_error"), F.count(F.lit(1)).alias("n"))


def length_control(a: DataFrame, gap: float, n_deciles: int = 10, key: str = "sample_id", length: str = "n_tokens") -> DataFrame:
    """One row: the score's pair accuracy within problems over pairs of targets over ``gap`` apart (overall), and mean and least of the same within deciles of length, and the deciles used. Where length explains the score, the latter fall."""
    qs = [i / n_deciles for i in range(1, n_deciles)]
    lo, hi = a.agg(F.min(length), F.max(length)).first()
    decile = sum((F.when(F.col(length) >= e, 1).otherwise(0) for e in quantiles(a, length, qs)), F.lit(0))
    d = a.withColumn("decile", decile).select(*PROBLEM, key, "score", "target", "decile")
    x, y = (d.select(*PROBLEM, *(F.col(c).alias(f"{c}_{s}") for c in (key, "score", "target", "decile"))) for s in "xy")
    # a problem's anchors are its samples: tens
    p = x.join(y, PROBLEM).where(f"{key}_x < {key}_y AND abs(target_x - target_y) > {gap}")
    p = p.withColumn("right", ((F.col("score_x") > F.col("score_y")) == (F.col("target_x") > F.col("target_y"))).cast("double"))
    same = F.when(F.col("decile_x") == F.col("decile_y"), F.col("decile_x"))
    g = p.groupBy(same.alias("d")).agg(F.sum("right").alias("r"), F.count(F.lit(1)).alias("n"))
    acc = F.when(F.col("d").isNotNull(), F.col("r") / F.col("n")) if lo != hi else F.lit(None).cast("double")
    return g.agg(F.try_divide(F.sum("r"), F.sum("n")).alias("overall"), F.avg(acc).alias("decile_mean"), F.min(acc).alias("decile_min"), F.count(acc).alias("n_deciles_used"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


def per_list_metrics(items: DataFrame, group: list[str], key: str, score: str, rel: str) -> DataFrame:
    """(group, ndcg, pairs_correct, pairs_total, n_items) of each list: NDCG by gain 2^rel - 1, and the pairs that the score orders strictly right. An item without a score is an error."""
    s, r = F.col(score).cast("double"), F.col(rel).cast("double")
    # the one shuffle is by list, whose builder bounds its items; an item without a score sorts first
    own = items.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct((~F.isnan(s)).alias("rest"), (-s).alias("z"), F.col(key).alias("k"), r.alias("r")))).alias("x"),
        F.sort_array(F.collect_list(r), asc=False).alias("ideal"),
        F.count_if(s.isNull()).alias("lost"),
        F.count(F.lit(1)).alias("n_items"),
    )
    total = lambda a, v: F.aggregate(F.transform(a, lambda e, i: F.coalesce((F.pow(F.lit(2.0), v(e)) - 1) / F.log2(i + 2.0), F.lit(0.0))), F.lit(0.0), lambda m, e: m + e)
    pairs = lambda test: F.aggregate("x", F.lit(0).cast("long"), lambda m, a: m + F.size(F.filter("x", lambda b: (a["k"] < b["k"]) & (a["r"] != b["r"]) & test(a, b))))
    out = own.select(
        *group,
        "n_items",
        total("x", lambda e: e["r"]).alias("dcg"),
        total("ideal", lambda e: e).alias("idcg"),
        pairs(lambda a, b: (a["r"] - b["r"]) * (b["z"] - a["z"]) > 0).alias("pairs_correct"),
        pairs(lambda a, b: F.lit(True)).alias("pairs_total"),
        "lost",
    )
    out = written(out, "list-metrics")  # read for the check and for reports
    lost = out.where("lost > 0").select(*group).limit(1).collect()
    if lost:
        raise KeyError(f"an item of {lost[0].asDict()} was never scored")
    return out.select(*group, "n_items", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), "pairs_correct", "pairs_total")


def rank_report(lists: DataFrame, depth: str, edges: list[float]) -> DataFrame:
    """A row for each depth band (empty ones too, their metrics null) and one for all (band null): lists, items, pairs, pooled pair accuracy, mean NDCG, lists of two, lists outside the window."""
    d = lists.withColumn("band", L.band_of(F.col(depth), edges))
    out = [F.count("ndcg").alias("n_lists"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("pairs_total"), F.lit(0)).alias("n_pairs"), F.try_divide(F.sum("pairs_correct"), F.sum("pairs_total")).alias("pairwise_acc"), F.avg("ndcg").alias("ndcg"), F.count_if(F.col("n_items") == 2).alias("two_item_lists"), F.count_if((F.col(depth) < edges[0]) | (F.col(depth) > edges[-1])).alias("outside")]
    # one pass over lists for the bands and for all
    d = d.rollup("band").agg(F.grouping("band").alias("_all"), *out)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lists", "n_items", "n_pairs")]
    keys = lists.sparkSession.range(len(edges)).select(F.when(F.col("id") < len(edges) - 1, F.col("id").cast("int")).alias("band"), (F.col("id") == len(edges) - 1).cast("int").alias("_all"))
    d = keys.join(d.withColumnRenamed("band", "_band").withColumnRenamed("_all", "_of"), F.col("band").eqNullSafe(F.col("_band")) & (F.col("_all") == F.col("_of")), "left")
    return d.select("band", *zero, "pairwise_acc", "ndcg", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("two_item_lists", "outside")))


def beats_null(lists: DataFrame, null: DataFrame, q: float = NULL_Q) -> DataFrame:
    """One row: lists, how many spread further than the q-quantile of their own null (column ``spreads``), their share, and the median spread."""
    d = lists.join(null, "list_key")
    own = F.col("spread") > quantile(F.col("spreads"), q)
    return d.agg(F.count(F.lit(1)).alias("lists"), F.count_if(own).alias("beats_null"), L.percent(F.count_if(own), F.count(F.lit(1))).alias("beats_null_pct"), F.median("spread").alias("median"))


def corpus_scan(rows: DataFrame) -> DataFrame:
    """One row for each run and one for all (run null): rows, correct, compiled, unterminated, problems, off-scale targets, targets in the empty band, sum of cuts, cuts in code."""
    t = F.col("target")
    out = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if("correct").alias("correct"),
        F.count_if("compiled").alias("compiled"),
        F.count_if("unterminated").alias("unterminated"),
        F.countDistinct(*PROBLEM).alias("problems"),
        F.count_if(~F.when(F.col("label") == 1, (t >= 0.5) & (t <= 1.0)).otherwise(t == 0.0)).alias("off_scale"),
        F.count_if((t > 0) & (t < 0.5)).alias("empty_band"),
        F.coalesce(F.sum("n_cuts"), F.lit(0)).alias("cuts"),
        F.coalesce(F.sum("n_code_cuts"), F.lit(0)).alias("code_cuts"),
    ]
    return rows.groupBy("run_name").agg(*out).unionByName(rows.agg(F.lit(None).cast("string").alias("run_name"), *out))


def cut_summary(rows: DataFrame, n: str = "n_cuts") -> DataFrame:
    """One row: mean, median and the values at places floor(0.05 n) and floor(0.95 n) of the sorted cut counts. Counts of equal values come first, so only distinct ones are ordered."""
    by = rows.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    up = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by = by.withColumns({"upto": up, "n": F.sum("c").over(Window.partitionBy())})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    half = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), half.alias("median"), at(F.floor(F.col("n") * 0.05)).alias("p5"), at(F.floor(F.col("n") * 0.95)).alias("p95"))


def base_rates(verdicts: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: verdicts, share of correct ones over all, over kept rows and over dropped ones, and the shift in points."""
    a = verdicts.agg(F.count(F.lit(1)).alias("graded"), F.count_if("correct").alias("graded_correct"))
    k = kept.agg(F.count(F.lit(1)).alias("rows"), F.count_if("correct").alias("rows_correct"))
    d = a.crossJoin(F.broadcast(k))  # one row each
    every, some = L.percent(F.col("graded_correct"), F.col("graded")), L.percent(F.col("rows_correct"), F.col("rows"))
    return d.select("graded", "rows", every.alias("all_correct_pct"), some.alias("kept_correct_pct"), L.percent(F.col("graded_correct") - F.col("rows_correct"), F.col("graded") - F.col("rows")).alias("dropped_correct_pct"), (some - every).alias("shift_points"))


def campaign_checks(facts: DataFrame) -> DataFrame:
    """(check, ok, bad) of a campaign from its one row of facts: truncated, rollouts, too_few, prefixes, all_equal, lists, val_lists, leaked, spanning, empty_bands, outside, beats_null, built, and evals_per_gpu_hour (null if unrecorded)."""
    c, pct = F.col, L.percent
    lo, hi = ALL_EQUAL_PCT
    equal = pct(c("all_equal"), c("all_equal") + c("lists"))
    return expectations(
        facts,
        [
            ("rollouts_truncated", pct(c("truncated"), c("rollouts")) < MAX_TRUNCATED_PCT),
            ("too_few_rollouts", pct(c("too_few"), c("prefixes")) < MAX_TOO_FEW_PCT),
            ("all_equal_lists", (equal >= lo) & (equal <= hi)),
            ("usable_lists", (c("lists") >= MIN_LISTS) & (c("val_lists") >= MIN_VAL_LISTS)),
            ("val_prefixes", c("leaked") == 0),
            ("one_key_lists", c("spanning") == 0),
            ("bands_populated", c("empty_bands") == 0),
            ("inside_window", c("outside") == 0),
            ("beats_own_null", pct(c("beats_null"), c("built")) > 100 * (1 - NULL_Q)),
            ("gpu_hours_recorded", c("evals_per_gpu_hour").isNotNull()),
        ],
    )


def checked_label_source(values: DataFrame, label_source: str) -> DataFrame:
    """``values``, or an error where any carries another label source than the one named."""
    other = values.where(F.col("label_source") != label_source).select("label_source").limit(1).collect()
    if other:
        raise ValueError(f"values carry label source {other[0][0]!r}, not {label_source!r}")
    return values


# batches


def length_batches(rows: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """(key, batch, slot): rows in order of length, longest first, in batches of ``size``. Ranks come from counts of length ranges, so no task sorts all rows."""
    if size < 1:
        raise ValueError(f"a batch size of {size}")
    counts = rows.groupBy(length).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(F.col(length).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    place = F.col("before") + F.row_number().over(Window.partitionBy(length).orderBy(key)) - 1
    return rows.join(counts, length).withColumn("place", place).select(key, F.floor(F.col("place") / size).alias("batch"), (F.col("place") % size).alias("slot"))


def budget_buckets(rows: DataFrame, budget: str, size: int) -> DataFrame:
    """(budget, calls, rows): rows of equal token budget share calls of up to ``size``."""
    return rows.groupBy(budget).agg(F.ceil(F.count(F.lit(1)) / size).alias("calls"), F.count(F.lit(1)).alias("rows"))


def tally(findings: DataFrame, severities: tuple[str, ...] = ("fail", "warn", "info")) -> DataFrame:
    """(check_id, files, and findings of each severity) over scanned files."""
    return findings.groupBy("check_id").agg(F.countDistinct("path").alias("files"), *(F.count_if(F.col("severity") == s).alias(s) for s in severities))


# prefixes of completions


def group_depths(rows: DataFrame, group: list[str], per_group: int, lo: float, hi: float, seed: int) -> DataFrame:
    """(group, k): the cuts at which a group's completions are cut: a draw from each of ``per_group`` strata of the window, on the ruler of the low median of the group's cuts, rounded to a cut inside the window. Groups too short for any have none."""
    g = rows.groupBy(*group).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_cuts_total)").cast("int").alias("n"))
    g = g.withColumns({"first": F.greatest(F.lit(1), F.ceil(F.lit(lo) * F.col("n"))), "last": F.least(F.col("n") - 1, F.floor(F.lit(hi) * F.col("n")))}).where("first <= last")
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))))
    u = L.hash_uniform(seed, *map(F.col, group), F.lit(0), F.col("j"))
    t = F.lit(lo) + (F.col("j") + u) * ((hi - lo) / per_group)
    k = F.least(F.col("last"), F.greatest(F.col("first"), F.bround(t * F.col("n")))).cast("int")
    return g.select(*group, k.alias("k")).distinct()


def cut_prefixes(rows: DataFrame, splits: DataFrame, per_group: int = 4, lo: float = 0.1, hi: float = 0.9, min_size: int = 2, max_size: int = 8, seed: int = 42, dead: DataFrame | None = None) -> DataFrame:
    """The prefixes of a campaign: rows (run_name, shard, level, problem_id, sample_id, stem, cuts: array of struct(char, kind, index)) of train and val problems, cut at their group's depths, where they have a cut so deep; inside the window, capped, and in lists of ``min_size`` or more. A problem without a split is an error."""
    group = ["run_name", *PROBLEM]
    r = rows.withColumn("n_cuts_total", n_cuts_total(F.col("cuts")))
    if dead is not None:
        r = r.join(dead.select(*PROBLEM), PROBLEM, "left_anti")
    lost = r.select(*PROBLEM).distinct().join(splits, PROBLEM, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"problem {tuple(lost[0])} has no split")
    # a group's cuts and split come to its rows in one join, so that the arrays of cuts travel once
    depths = group_depths(r, group, per_group, lo, hi, seed).join(splits.where(F.col("split").isin("train", "val")), PROBLEM)
    d = r.join(depths.groupBy(*group, "split").agg(F.collect_list("k").alias("ks")), group).withColumn("k", F.explode("ks")).drop("ks")
    cut = F.get(F.filter("cuts", lambda c: c["index"] == F.col("k")), F.lit(0))
    d = d.withColumn("cut", cut).where("cut IS NOT NULL")
    p = d.select(
        F.format_string("%s__%s__p%d__s%d__k%03d", "run_name", F.replace("shard", F.lit("_"), F.lit("")), "problem_id", "sample_id", "k").alias("prefix_id"),
        "run_name",
        "shard",
        *PROBLEM,
        "sample_id",
        "stem",
        F.col("cut.char").alias("cut_char"),
        F.col("k").alias("cut_index"),
        F.col("cut.kind").alias("cut_kind"),
        "n_cuts_total",
        (F.col("k") / F.col("n_cuts_total")).alias("rel_depth"),
        F.concat_ws(":", *(F.col(c).cast("string") for c in (*group, "k"))).alias("list_key"),
        "split",
    )
    return stratified(require_unique(written(p, "prefixes"), ["prefix_id"], "prefix"), lo, hi, min_size, max_size, seed)


def check_layout(rows: DataFrame) -> DataFrame:
    """``rows``, or an error where one group's samples lie in two parts: a campaign reads part by part."""
    bad = rows.groupBy("run_name", *PROBLEM).agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b").limit(1).collect()
    if bad:
        raise ValueError(f"a problem's samples lie in two shards: {bad[0].asDict()}")
    return rows


def rollout_manifest(units: DataFrame) -> DataFrame:
    """One row of totals over units (unit, prefixes, rollouts, seconds, prefix_caching, reused): prefix_caching is null where any unit could not say."""
    known = F.count("prefix_caching") == F.count(F.lit(1))
    return units.agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(~F.col("reused")).alias("units_generated"),
        F.count_if("reused").alias("units_reused"),
        F.sum("prefixes").alias("prefixes"),
        F.sum("rollouts").alias("rollouts"),
        F.sum("seconds").alias("seconds"),
        F.when(known, F.bool_and("prefix_caching")).alias("prefix_caching"),
    )


def sources_of(prefixes: DataFrame, rows: DataFrame) -> DataFrame:
    """Prefixes with the prompt and text that they were cut from, by run, shard and stem; a prefix whose completion is missing is an error."""
    key = ["run_name", "shard", "stem"]
    lost = prefixes.join(rows.select(*key), key, "left_anti").select("prefix_id").limit(1).collect()
    if lost:
        raise KeyError(f"{lost[0][0]} was cut from a completion that is not there")
    return prefixes.join(rows.select(*key, "prompt", "raw"), key)


def graded_pool(pool: DataFrame, verdicts: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Each finished candidate of a search with whether it is right, and its speedup (null if wrong, unmeasured or without a baseline)."""
    d = pool.join(verdicts, [*PROBLEM, "sample_id"], "left").withColumn("ok", F.coalesce("compiled", F.lit(False)) & F.coalesce("correct", F.lit(False)))
    if baselines is None:
        return d
    return d.join(baselines, PROBLEM, "left").withColumn("up", F.when(F.col("ok") & (F.col("runtime") > 0) & (F.col("base_mean") > 0), F.col("base_mean") / F.col("runtime")))


def search_report(graded: DataFrame, by: list[str]) -> DataFrame:
    """For each key: problems, share whose picked candidate is right, whose pool holds a right one, their difference, share whose best by the process scorer is right, mean pool; geometric means of speedups of each choice."""
    top = lambda s: F.max_by(F.col("ok").cast("int"), F.struct(F.coalesce(F.col(s), F.lit(float("-inf"))), -F.col("sample_id")))
    fast = lambda s: F.max_by("up", F.struct(F.coalesce(F.col(s), F.lit(float("-inf"))), -F.col("sample_id")))
    one = graded.groupBy(*dict.fromkeys([*by, *PROBLEM])).agg(top("orm").alias("picked"), F.max(F.col("ok").cast("int")).alias("oracle"), top("prm").alias("prm"), F.count(F.lit(1)).alias("pool"), fast("orm").alias("up_orm"), fast("prm").alias("up_prm"), F.max("up").alias("up_oracle"))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return one.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_problems"),
        rate("picked").alias("picked_correct"),
        rate("oracle").alias("oracle_correct"),
        (rate("oracle") - rate("picked")).alias("selection_regret"),
        rate("prm").alias("prm_top1_hit"),
        F.avg("pool").alias("pool_size"),
        *(L.geo_mean(F.col(f"up_{s}")).alias(f"geo_{s}") for s in ("orm", "prm", "oracle")),
    )
