"""Builds: drop ladders and ledgers, splits, duplicates and slots, lists, prefixes, shards, value estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..sources.scratch import written

PROBLEM = ["level", "problem_id"]


def with_drop_reason(c: DataFrame, excluded: DataFrame, max_chars: int | None = None, mode: str = "graded") -> DataFrame:
    """One ``drop_reason`` for each row, by the first rule that holds; null keeps the row."""
    c = c.join(excluded.select(*PROBLEM).distinct().withColumn("_out", F.lit(True)), PROBLEM, "left")
    state = L.truncation_state(F.col("trace"))
    rules = [("excluded", F.col("_out").isNotNull()), ("truncated", state == L.TRUNCATED), ("no_finish_reason", state == L.UNKNOWN)]
    if mode == "graded":
        rules += [("no_runtime", (F.col("label") == 1) & ~L.usable(F.col("runtime"))), ("no_baseline", (F.col("label") == 1) & F.col("speedup").isNull())]
    if max_chars is not None:
        rules.append(("too_long", F.length("raw") > max_chars))
    return c.withColumn("drop_reason", L.first_reason(*rules)).drop("_out")


def ledger(c: DataFrame, by: list[str]) -> DataFrame:
    """Rows kept and dropped for each reason; kept + drops = attempts."""
    return c.groupBy(*by, F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def two_level_rank(df: DataFrame, within: list[str], bucket: Column, order: list, rank: str, total: str | None = None) -> DataFrame:
    """``df`` with its rank (from 1) within a key, and the key's rows: ``bucket`` must rise with the order. Counts of buckets give what stands before each, so no task orders a whole key."""
    d = df.withColumn("_bucket", bucket)
    counts = d.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    key = Window.partitionBy(*within)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_c").over(key)}).drop("_c")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*within, "_bucket")]
    d = d.alias("a").join(counts.alias("b"), on).select("a.*", "b._before", "b._all")
    d = d.withColumn(rank, F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order)))
    if total:
        d = d.withColumn(total, F.col("_all"))
    return d.drop("_bucket", "_before", "_all")


def splits(problems: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0, stratify: list[str] | None = None) -> DataFrame:
    """train / val / test of each problem by rank of a hash of its key; sizes are half-even rounded shares of each stratum."""
    p = problems.select(*PROBLEM).distinct().withColumn("_h", L.hash_order(seed, *map(F.col, PROBLEM)))
    p = two_level_rank(p, stratify or [], F.substring("_h", 1, 3), ["_h", *PROBLEM], "_r", "_n")
    n_train, n_val = F.bround(F.col("_n") * ratios[0]), F.bround(F.col("_n") * ratios[1])
    return p.select(*PROBLEM, F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test").alias("split"))


def first_copies(df: DataFrame, within: list[str], text: str, order: list[str]) -> DataFrame:
    """The first row of each text within a key, by an explicit order."""
    w = Window.partitionBy(*within, F.sha1(F.col(text))).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dense_slots(df: DataFrame, within: list[str], text: str, rid: str) -> DataFrame:
    """rid, owner (first rid with the same text within the key), slot (0, 1, 2, ... of the owner) and shared (not the owner itself)."""
    # written, as it is read for the owners and for all rows
    d = written(df.select(*within, rid, F.unhex(F.sha1(F.col(text))).alias("_sha")), "texts")
    owners = d.groupBy(*within, "_sha").agg(F.min(rid).alias("owner"))
    number = owners.schema["owner"].dataType.typeName() in ("byte", "short", "integer", "long")
    # ids in order: ranges of numbers, or what a text begins with
    bucket = F.floor(F.col("owner") / 4096) if number else F.substring(F.col("owner").cast("string"), 1, 6)
    owners = two_level_rank(owners, within, bucket, ["owner"], "slot").withColumn("slot", (F.col("slot") - 1).cast("int"))
    return d.join(owners, [*within, "_sha"]).select(rid, *within, "owner", "slot", (F.col("owner") != F.col(rid)).alias("shared"))


def problem_slots(df: DataFrame, within: list[str], text: str, rid: str) -> DataFrame:
    """``df`` with the owner, slot and shared of ``dense_slots``, where the rows of a key are few, as those of a problem are: they are numbered where their key's rows lie, and nothing is written. Rows without a text share one; a row without an id has no slot of its own."""
    d = df.withColumn("_sha", F.unhex(F.sha1(F.col(text))))
    d = d.withColumn("owner", F.min(rid).over(Window.partitionBy(*within, "_sha"))).drop("_sha")
    slot = F.dense_rank().over(Window.partitionBy(*within).orderBy(F.col("owner").asc_nulls_last())) - 1
    return d.withColumns({"slot": slot, "shared": F.coalesce(F.col("owner") != F.col(rid), F.lit(True))})


def shard_ranges(ids: DataFrame, key: str, n_shards: int) -> DataFrame:
    """lo, hi and count of chunk k = rows [k N / n, (k + 1) N / n) of the sorted distinct ids. Ranks come from counts of id ranges, so no single task sorts all ids."""
    ids = ids.select(F.col(key).cast("long").alias("id")).distinct()
    width = 1 << 12
    ids = ids.withColumn("_b", F.floor(F.col("id") / width))
    counts = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("c").over(Window.partitionBy()))
    rn = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("id"))
    ranked = ids.join(counts, "_b").withColumn("rn", rn)
    shard = F.floor((F.col("rn") * n_shards - 1) / F.col("_n")).cast("int")
    return ranked.groupBy(shard.alias("shard")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))


def plan_shards(counts: list[tuple[int, int]], n_shards: int) -> list[dict]:
    """Contiguous packing of (problem, samples) in id order: a group closes when its running count reaches total / n, and the count restarts. A driver loop over problems, a bounded table of keys; ``shard_plan`` is for many."""
    total, out, start, running, most = sum(n for _, n in counts), [], None, 0, 0
    for pid, n in sorted(counts):
        start = pid if start is None else start
        running, most = running + n, max(most, n)
        if running * n_shards >= total and len(out) < n_shards - 1:
            out.append({"shard": len(out), "first": start, "last": pid, "n": running, "max_samples": most})
            start, running, most = None, 0, 0
    if start is not None:
        out.append({"shard": len(out), "first": start, "last": pid, "n": running, "max_samples": most})
    return out


def shard_plan(rows: DataFrame, key: str, n_shards: int) -> DataFrame:
    """``plan_shards`` over every key of ``rows``. Running counts come from counts of key ranges, so no single task sorts all keys; the driver sees one key for each shard."""
    width = 1 << 12
    k = rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("c")).where("id IS NOT NULL").withColumn("_b", F.floor(F.col("id") / width))
    before = k.groupBy("_b").agg(F.sum("c").alias("s")).withColumn("_before", F.coalesce(F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    k = k.join(before, "_b").withColumn("upto", F.col("_before") + F.sum("c").over(Window.partitionBy("_b").orderBy("id"))).select("id", "c", "upto").persist()
    try:
        total, done, ends = k.agg(F.max("upto")).first()[0] or 0, 0, []
        while len(ends) < n_shards - 1:
            last = k.where((F.col("upto") - done) * n_shards >= total).agg(F.min(F.struct("id", "upto"))).first()[0]
            if last is None:
                break
            ends.append(last[0])
            done = last[1]
        shard = F.lit(0)
        for e in ends:
            shard = shard + (F.col("id") > e).cast("int")
        out = k.groupBy(shard.alias("shard")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("c").alias("n"), F.max("c").alias("max_samples")).collect()
    finally:
        k.unpersist()
    return rows.sparkSession.createDataFrame(sorted(map(tuple, out)), "shard int, first long, last long, n long, max_samples long")


def ranked_lists(c: DataFrame, max_pos: int = 4, max_neg: int = 4, min_size: int = 3, seed: int = 0, **scale: float) -> DataFrame:
    """(problem, sample_id, rel): a spread of the positives by rel and a hash draw of the negatives; lists that are too small or all alike drop out."""
    c = c.withColumn("rel", F.round(2 * L.target(F.col("label"), F.col("speedup"), **scale), 6)).where("rel IS NOT NULL")
    key = Window.partitionBy(*PROBLEM, "label")
    c = c.withColumns({"_n": F.count(F.lit(1)).over(key), "_asc": F.row_number().over(key.orderBy("rel", "sample_id")) - 1, "_h": F.row_number().over(key.orderBy(L.hash_order(seed, *map(F.col, [*PROBLEM, "sample_id"])), "sample_id"))})
    keep = F.when(F.col("label") == 1, (F.col("_n") <= max_pos) | F.array_contains(_spread(F.col("_n"), max_pos), F.col("_asc"))).otherwise(F.col("_h") <= max_neg)
    c = c.where(keep)
    w = Window.partitionBy(*PROBLEM)
    return c.withColumns({"_m": F.count(F.lit(1)).over(w), "_lo": F.min("rel").over(w), "_hi": F.max("rel").over(w)}).where(f"_m >= {min_size} AND _lo < _hi").select(*PROBLEM, "sample_id", "rel")


def _spread(n: Column, k: int) -> Column:
    """Places of k out of n in rising order, evenly spread from the first to the last; of one the last, which is the fastest."""
    if k <= 1:
        return F.array((n - 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1))).cast("int"))


def value_estimates(rollouts: DataFrame, by: list[str], min_rollouts: int = 1) -> DataFrame:
    """Measured values of each prefix: binary and graded means with standard errors (population / sample), counts, and drops of ungradable rollouts."""
    g = rollouts.groupBy(*by).agg(
        F.count("target").alias("n"),
        F.count_if(F.col("target").isNull()).alias("n_dropped"),
        F.count_if(F.col("target").isNotNull() & F.col("compiled")).alias("n_compiled"),
        F.count_if(F.col("target").isNotNull() & F.col("correct")).alias("n_correct"),
        F.avg("target").alias("v_graded"),
        F.stddev_samp("target").alias("_sd"),
    )
    p = F.col("n_correct") / F.col("n")
    g = g.where(F.col("n") >= max(1, min_rollouts))
    return g.select(
        *by, "n", "n_dropped", "n_compiled", "n_correct", p.alias("v_binary"), "v_graded", F.sqrt(p * (1 - p) / F.col("n")).alias("se_binary"), F.when(F.col("n") > 1, F.col("_sd") / F.sqrt("n")).otherwise(0.0).alias("se_graded")
    )


def histogram(values: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts of tenths, every bin emitted, the top one closed."""
    spark = values.sparkSession
    h = values.where(F.col(value).isNotNull()).groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def depth_bands(rows: DataFrame, depth: str, lo: float, hi: float, n: int) -> DataFrame:
    edges = L.band_edges(lo, hi, n)
    h = rows.groupBy(L.band_of(F.col(depth), edges).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col(depth) < lo) | (F.col(depth) > hi)).alias("outside"))
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("band")).join(h, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("outside", F.lit(0)).alias("outside"))


def funnel(prefixes: DataFrame, measured: DataFrame, lists: DataFrame, attr: str, key: str) -> DataFrame:
    """Prefixes, measured and listed ones for each value of an attribute; zero rows stay."""
    part = lambda d, name: d.groupBy(attr).agg(F.countDistinct(key).alias(name))
    out = part(prefixes, "n_prefixes").join(part(measured, "n_measured"), attr, "full").join(part(lists, "n_listed"), attr, "full")
    return out.select(attr, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_prefixes", "n_measured", "n_listed")))


def dead_problems(rows: DataFrame, target: str = "target") -> DataFrame:
    """Problems whose best target is 0 or less; those without any row are absent."""
    return rows.where(F.col(target).isNotNull()).groupBy(*PROBLEM).agg(F.max(target).alias("best")).where("best <= 0").select(*PROBLEM)


def sampled_depths(c: DataFrame, n_strata: int, lo: float, hi: float, seed: int) -> DataFrame:
    """(problem, depth): a jittered depth for each stratum of the window, on the ruler of the low median of the group's lengths."""
    g = c.groupBy(*PROBLEM).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_cuts)").cast("int").alias("ruler"))
    g = g.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_strata - 1))))
    u = L.hash_uniform(seed, *map(F.col, PROBLEM), F.col("_s"))
    rel = F.lit(lo) + (F.col("_s") + u) * ((hi - lo) / n_strata)
    depth = F.least(F.greatest(F.floor(rel * F.col("ruler")), F.ceil(F.lit(lo) * F.col("ruler"))), F.floor(F.lit(hi) * F.col("ruler"))).cast("int")
    return g.select(*PROBLEM, "ruler", depth.alias("depth")).where("depth >= 1").distinct()


def null_spreads(scores: DataFrame, list_key: list[str], item: str, score: str, rounds: int, seed: int) -> DataFrame:
    """Bootstrap null of each list's spread (list_key, spreads: one for each round): every item redraws its scores from the list's pool, by hash; a spread is the range of item means, on the scale of the scores. A list stays in its row, as its builder bounds it.

    One digest a list; a draw is a few whole-number steps on it, by the item's rank in its list and the score's in its item. Draws are made and folded in arrays of bounded size, many lists at a time: as rows, a round for each item, they would outgrow a task's memory and spill.
    """
    # by number, so that the few lists are not put together before their many draws are made
    dealt = scores.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), *list_key)
    items = dealt.groupBy(*list_key, item).agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_list(score).alias("s"))
    d = items.groupBy(*list_key).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("pool"), F.transform(F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), "n"))), lambda x: x["n"]).alias("sizes"))
    seeded = d.select(*list_key, "pool", "sizes", L.hash_seed(seed, *map(F.col, list_key)).alias("_seed"))
    return seeded.select(*list_key, _redrawn(rounds)("pool", "sizes", "_seed").alias("spreads"))


#: Draws that a task holds at once, beside a single list's.
MAX_DRAWS = 1 << 20


def _redrawn(rounds: int):
    """A function of columns (pool, sizes of items, seed): the spread of each round, of many lists at a time."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def spreads(pool: pd.Series, sizes: pd.Series, seed: pd.Series) -> pd.Series:
        out, start, held = [], 0, 0
        for end in range(1, len(pool) + 1):
            held += len(sizes.iat[end - 1]) * rounds
            if held >= MAX_DRAWS or end == len(pool):
                out += _redraw(list(pool.iloc[start:end]), list(sizes.iloc[start:end]), seed.to_numpy()[start:end], rounds)
                start, held = end, 0
        return pd.Series(out, dtype=object)

    return spreads


def _redraw(pools: list, sizes: list, seeds: np.ndarray, rounds: int) -> list[np.ndarray]:
    """Spreads of lists, a row of ``rounds`` for each; a list without scores has none. Scores of an item are added in their order."""
    pools = [np.asarray(x, dtype="float64") for x in pools]
    some = [i for i, x in enumerate(pools) if len(x)]
    out = [np.empty(0)] * len(pools)
    if not some:
        return out
    widths = np.array([len(pools[i]) for i in some])
    scores, first = np.concatenate([pools[i] for i in some]), np.cumsum(widths) - widths
    counts = np.array([len(sizes[i]) for i in some])
    items, begins = np.concatenate([np.asarray(sizes[i], dtype="int64") for i in some]), np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(some)), counts)  # an item's list
    place = np.arange(len(items)) - begins[of]
    start = seeds[some].astype("int64")[of] + place * (65536 * L.ITEM_STEP)
    steps = np.arange(rounds, dtype="int64") * L.ROUND_STEP
    sums = np.zeros((len(items), rounds))
    for k in range(items.max()):
        who = np.flatnonzero(items > k)
        x = (start[who, None] + k * L.ITEM_STEP + steps) & L.LOW32
        for _ in range(2):
            x = ((x ^ (x >> 16)) * L.MIX) & L.LOW32
        u = (x ^ (x >> 16)) / float(1 << 32)
        sums[who] += scores[first[of[who], None] + np.floor(u * widths[of[who], None]).astype("int64")]
    means = sums / items[:, None]
    spread = np.maximum.reduceat(means, begins) - np.minimum.reduceat(means, begins)
    for i, row in zip(some, spread, strict=True):
        out[i] = row
    return out


def null_sql(scores: str, key: list[str], item: str, score: str, rounds: int, seed: int) -> str:
    """The same as CTEs for DuckDB: ``null_lists`` (key, pool, seed), ``null_spread`` (key, r, spread)."""
    k = ", ".join(key)
    text = " || ':' || ".join(key)
    step = lambda x: f"(xor({x}, {x} >> 16) * {L.MIX}) & {L.LOW32}"
    return f"""null_lists AS (SELECT {k}, list_sort(list({score})) AS pool, ('0x' || substr(md5('{seed}:' || {text}), 1, 8))::BIGINT AS seed FROM {scores} GROUP BY {k}),
null_items AS (SELECT {k}, {item}, count(*) AS n, row_number() OVER (PARTITION BY {k} ORDER BY {item}) - 1 AS place FROM {scores} GROUP BY {k}, {item}),
null_draws AS (SELECT {k}, place, r.range AS r, j.range AS j, n, pool, (seed + r.range * {L.ROUND_STEP} + (place * 65536 + j.range) * {L.ITEM_STEP}) & {L.LOW32} AS x0 FROM null_items JOIN null_lists USING ({k}), range({rounds}) r, LATERAL range(n) j),
null_mixed AS (SELECT *, {step("x1")} AS x2 FROM (SELECT *, {step("x0")} AS x1 FROM null_draws)),
null_means AS (SELECT {k}, r, place, CASE WHEN any_value(n) = 1 THEN max(v) ELSE sum(v ORDER BY j) / any_value(n) END AS m FROM (SELECT *, pool[1 + floor(xor(x2, x2 >> 16) / 4294967296.0::DOUBLE * len(pool))::BIGINT] AS v FROM null_mixed) GROUP BY {k}, r, place),
null_spread AS (SELECT {k}, r, max(m) - min(m) AS spread FROM null_means GROUP BY {k}, r)"""


def quantile(xs: Column, q: float) -> Column:
    """The q-th quantile of an array by nearest rank, without interpolation: place min(floor(q n), n - 1) of the sorted values."""
    return F.get(F.array_sort(xs), F.least(F.floor(F.lit(q) * F.size(xs)), F.size(xs) - 1).cast("int"))


def expectations(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(check, ok, bad): for each condition whether all rows meet it, and how many do not. One pass."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(checks)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), (F.col(f"c{i}") == 0).alias("ok"), F.col(f"c{i}").alias("bad")) for i, (n, _) in enumerate(checks)))).alias("x")).select("x.*")


def require_unique(df: DataFrame, key: list[str], what: str) -> DataFrame:
    """``df``, or an error that names a repeated key."""
    bad = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"duplicate {what}: {bad[0].asDict()}")
    return df


def quantiles(df: DataFrame, column: str, qs: list[float], buckets: int = 1024) -> list[float]:
    """Exact quantiles with linear interpolation; [] without values.

    The column is written once. Then all places are looked for together: a round counts equal ranges of each open
    range and keeps those that hold a place, until a range holds one value. A round is one scan of one column, a few
    rounds are enough, and no task, and not the driver, holds the values.
    """
    v = F.col(column).cast("double")
    rows = written(df.select(v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), "values")
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    n, least, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.min(finite), F.lit(0.0)), F.coalesce(F.max(finite), F.lit(0.0))).first()
    if not n:
        return []
    open_ = {(float("-inf"), float("inf")): (least, most, 0)}  # range to its finite ends and the rows before it
    at = {p: (float("-inf"), float("inf")) for q in qs for p in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))}
    value: dict[int, float] = {}
    while at:
        ranges = sorted({r for p, r in at.items()})
        which = F.lit(None).cast("int")
        bucket = F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(ranges):
            a, b, _ = open_[lo, hi]
            inside = F.col("v").between(lo, hi)
            place = F.when(F.col("v") < a, -1).when(F.col("v") > b, buckets).otherwise(F.least(F.floor((F.col("v") - a) / (b - a or 1.0) * buckets), F.lit(buckets - 1)).cast("int"))
            which, bucket = F.when(inside, i).otherwise(which), F.when(inside, place).otherwise(bucket)
        found = rows.select(which.alias("i"), bucket.alias("b"), "v").where("i IS NOT NULL").groupBy("i", "b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # buckets + 2 a range at most
        cut: dict[int, list] = {}
        for r in sorted(found):
            cut.setdefault(r["i"], []).append(r)
        for p in list(at):
            i = ranges.index(at[p])
            before = open_[at[p]][2]
            for r in cut[i]:
                if p < before + r["c"]:
                    break
                before += r["c"]
            if r["lo"] == r["hi"]:
                value[p] = r["lo"]
                del at[p]
            else:
                at[p] = r["lo"], r["hi"]
                open_[at[p]] = r["lo"], r["hi"], before
    out = []
    for q in qs:
        i = int(q * (n - 1))
        a, b = value[i], value[min(i + 1, n - 1)]
        part = q * (n - 1) - i
        out.append(a + (b - a) * part if part and a != b else a)
    return out
