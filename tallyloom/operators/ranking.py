"""Ranking and classification metrics over scored groups. Ties are broken by an explicit key, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], score: str, tie: list[str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), *tie)))


def graded_ndcg(df: DataFrame, group: list[str], score: str, rel: str, tie: list[str]) -> DataFrame:
    """NDCG with gain 2^rel - 1 for each group; 0 where the ideal is 0."""
    d = ranked(ranked(df, group, score, tie, "_r"), group, rel, tie, "_i")
    gain = F.pow(F.lit(2.0), F.col(rel)) - 1
    d = d.groupBy(*group).agg(F.sum(gain / F.log2(F.col("_r") + 1.0)).alias("dcg"), F.sum(gain / F.log2(F.col("_i") + 1.0)).alias("idcg"))
    return d.select(*group, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def group_metrics(df: DataFrame, group: list[str], score: str, label: str, tie: list[str]) -> DataFrame:
    """pass@1 over all groups, recall@1 over groups with a positive, mean binary NDCG, coverage and the number of groups."""
    d = ranked(ranked(df, group, score, tie, "_r"), group, label, tie, "_i")
    y = F.col(label).cast("double")
    g = d.groupBy(*group).agg(
        F.max(F.when(F.col("_r") == 1, y)).alias("top"), F.max(y).alias("any"), F.sum(y / F.log2(F.col("_r") + 1.0)).alias("dcg"), F.sum(y / F.log2(F.col("_i") + 1.0)).alias("idcg")
    )
    return g.agg(
        F.avg("top").alias("pass_at_1"),
        F.avg(F.when(F.col("any") > 0, F.col("top"))).alias("recall_at_1"),
        F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("ndcg"),
        F.avg("any").alias("coverage"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def ordered_pairs(df: DataFrame, group: list[str], key: str, cols: list[str]) -> DataFrame:
    """Each unordered pair of a group once, columns suffixed _a and _b; the size of a list bounds the pairs of a row."""
    a = df.select(*group, F.col(key).alias(f"{key}_a"), *(F.col(c).alias(f"{c}_a") for c in cols))
    b = df.select(*group, F.col(key).alias(f"{key}_b"), *(F.col(c).alias(f"{c}_b") for c in cols))
    return a.join(b, group).where(F.col(f"{key}_a") < F.col(f"{key}_b"))


def longest_shared_prefix(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, n, longest) over all pairs of a group with different keys, without making pairs: n from counts; longest, up to 256 characters, in four rounds, as a prefix that two rows share is shared at every shorter length."""
    df = df.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    c = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("c")).groupBy(group).agg(F.expr("(sum(c) * sum(c) - sum(c * c)) div 2").alias("n"))
    heads = df.groupBy(group, text).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    best = c.where("n > 0").withColumn("longest", F.lit(0))
    for step, top in ((64, 4), (16, 3), (4, 3), (1, 3)):
        # the length found so far stays a row of its own, for groups without a longer one
        d = heads.join(best, group).withColumn("_n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda i: F.col("longest") + i * step)))
        d = d.where((F.col("_n") == F.col("longest")) | (F.length(text) >= F.col("_n")))
        d = d.withColumn("_p", F.when(F.col("_n") > F.col("longest"), F.col(text).substr(F.lit(1), F.col("_n"))))
        p = d.groupBy(group, "n", "longest", "_n", "_p").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        best = p.groupBy(group, "n").agg(F.max(F.when((F.col("_p").isNull()) | (F.col("_lo") < F.col("_hi")), F.col("_n"))).cast("int").alias("longest"))
    return best


def pair_accuracy(df: DataFrame, group: list[str], key: str, score: str, rel: str) -> DataFrame:
    """Pooled over all lists: pairs of different rel that the score orders strictly right (a tie is wrong)."""
    p = ordered_pairs(df, group, key, [score, rel]).where(F.col(f"{rel}_a") != F.col(f"{rel}_b"))
    right = ((F.col(f"{rel}_a") - F.col(f"{rel}_b")) * (F.col(f"{score}_a") - F.col(f"{score}_b"))) > 0
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(right.cast("double")).alias("accuracy"))


def pair_agreement(df: DataFrame, group: list[str], key: str, measured: str, imputed: str, gap: float) -> DataFrame:
    """Share of in-list pairs over ``gap`` apart for which (m_a > m_b) equals (i_a > i_b); a is the smaller key."""
    p = ordered_pairs(df, group, key, [measured, imputed]).where(F.abs(F.col(f"{measured}_a") - F.col(f"{measured}_b")) > gap)
    same = (F.col(f"{measured}_a") > F.col(f"{measured}_b")) == (F.col(f"{imputed}_a") > F.col(f"{imputed}_b"))
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(same.cast("double")).alias("agreement"))


def lambdarank(df: DataFrame, group: list[str], key: str, score: str, rel: str, sigma: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """|change of NDCG| weighted softplus for each list: pairs across correctness and pairs of speed are averaged apart and mixed by alpha; a missing side gives its weight to the other."""
    d = ranked(ranked(df, group, score, [key], "rank"), group, rel, [key], "_i").withColumn("gain", F.pow(F.lit(2.0), F.col(rel)) - 1)
    d = d.withColumn("idcg", F.sum(F.col("gain") / F.log2(F.col("_i") + 1.0)).over(Window.partitionBy(*group)))
    p = ordered_pairs(d, group, key, [score, rel, "rank", "gain", "idcg"]).where((F.col(f"{rel}_a") != F.col(f"{rel}_b")) & (F.col("idcg_a") > 0))
    delta = F.abs(F.col("gain_a") - F.col("gain_b")) * F.abs(1 / F.log2(F.col("rank_a") + 1.0) - 1 / F.log2(F.col("rank_b") + 1.0)) / F.col("idcg_a")
    diff = F.when(F.col(f"{rel}_a") > F.col(f"{rel}_b"), F.col(f"{score}_a") - F.col(f"{score}_b")).otherwise(F.col(f"{score}_b") - F.col(f"{score}_a"))
    loss = F.greatest(-sigma * diff, F.lit(0.0)) + F.log1p(F.exp(-F.abs(sigma * diff)))
    cross = (F.col(f"{rel}_a") > 0) != (F.col(f"{rel}_b") > 0)

    def mean(side: Column) -> Column:
        return F.try_divide(F.sum(F.when(side, delta * loss)), F.sum(F.when(side, delta)))

    g = p.groupBy(*group).agg(mean(cross).alias("correctness"), mean(~cross).alias("speed"))
    both = alpha * F.col("correctness") + (1 - alpha) * F.col("speed")
    return g.select(*group, F.coalesce(both, "correctness", "speed").alias("loss"))


def classification(df: DataFrame, score: str, label: str) -> DataFrame:
    """accuracy, precision, recall, f1 at sigmoid >= 0.5 (score >= 0), positive rate, ROC-AUC by average ranks, PR-AUC as average precision. Counts of equal scores come first, so ordering handles distinct scores only."""
    t = df.select(F.col(score).alias("s"), F.col(label).cast("long").alias("y"))
    by = t.groupBy("s").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    # running sums in two levels: over ranges of scores, then within each
    ends = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    by = by.crossJoin(F.broadcast(ends)).withColumn("b", F.coalesce(F.width_bucket("s", "lo", F.col("hi"), F.lit(1024)), F.lit(0))).drop("lo", "hi")  # one row
    parts = by.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = parts.withColumns({"p0": F.coalesce(F.sum("bp").over(above), F.lit(0)), "n0": F.coalesce(F.sum("bn").over(above), F.lit(0)), "pos": F.sum("bp").over(every), "all": F.sum("bn").over(every)}).drop("bp", "bn")
    down = Window.partitionBy("b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.join(parts, "b").withColumns({"tp": F.col("p0") + F.sum("p").over(down), "seen": F.col("n0") + F.sum("n").over(down)})
    neg = F.col("all") - F.col("pos")
    below = F.col("all") - F.col("seen") - (F.col("pos") - F.col("tp"))  # negatives of lower score
    auc = F.sum(F.col("p") * (below + (F.col("n") - F.col("p")) / 2.0))
    ap = F.sum(F.col("p") * F.col("tp") / F.col("seen"))
    one = F.max("pos"), F.max(neg)
    a = by.agg(
        F.sum(F.when(F.col("s") >= 0, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s") >= 0, F.col("n")).otherwise(0)).alias("pred"),
        F.max("pos").alias("pos"),
        F.max("all").alias("n"),
        F.when((one[0] > 0) & (one[1] > 0), auc / (one[0] * one[1])).alias("roc_auc"),
        F.when((one[0] > 0) & (one[1] > 0), ap / one[0]).alias("pr_auc"),
    )
    z = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    precision, recall = z(F.col("tp"), F.col("pred")), z(F.col("tp"), F.col("pos"))
    return a.select(
        F.col("n"),
        ((F.col("n") - F.col("pred") - F.col("pos") + 2 * F.col("tp")) / F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        z(2 * F.col("tp"), F.col("pred") + F.col("pos")).alias("f1"),
        (F.col("pos") / F.col("n")).alias("positive_rate"),
        "roc_auc",
        "pr_auc",
    )


def top_beam(df: DataFrame, problem: list[str], group: str, score: str, cid: str, width: int, groups: int) -> DataFrame:
    """The best width / groups of each group, by score, then id as text."""
    return ranked(df.withColumn("_cid", F.col(cid).cast("string")), [*problem, group], score, ["_cid"]).where(F.col("rank") <= width // groups).drop("_cid")


def spread_pick(n: int | Column, k: int) -> Column:
    """Ranks round(i (n - 1) / (k - 1)), half-even, of a spread of k out of n sorted rows."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(max(1, k - 1)))).cast("int")))


def fast_p(df: DataFrame, problem: list[str], speed: str, thresholds: list[float]) -> DataFrame:
    """Share of problems whose speed is strictly over each threshold; problems without a speed count as misses."""
    one = df.groupBy(*problem).agg(F.max(speed).alias("s"))
    rows = one.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("s") > p).alias(f"n{i}") for i, p in enumerate(thresholds)))
    return rows.select("n", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), (F.col(f"n{i}") / F.col("n")).alias("fast")) for i, p in enumerate(thresholds)))).alias("x")).select("n", "x.p", "x.fast")


def diversify(kept: list[tuple[str, str, float]], rest: list[tuple[str, str, float]], floor: int) -> list[str]:
    """Ids of a beam with at least ``floor`` parents where that can be had: the best unrepresented parent comes in for the weakest member that has a sibling. Members are (id, parent, score)."""
    beam = sorted(kept, key=lambda c: (-c[2], c[0]))
    pool = sorted(rest, key=lambda c: (-c[2], c[0]))
    while True:
        parents = [p for _, p, _ in beam]
        fresh = next((c for c in pool if c[1] not in parents), None)
        spare = next((c for c in reversed(beam) if parents.count(c[1]) > 1), None)
        if len(set(parents)) >= floor or fresh is None or spare is None:
            return [c[0] for c in sorted(beam, key=lambda c: (-c[2], c[0]))]
        beam[beam.index(spare)] = fresh
        pool.remove(fresh)
        beam.sort(key=lambda c: (-c[2], c[0]))


def diverse_beam(df: DataFrame, problem: list[str], score: str, cid: str, parent: str, width: int, floor: int) -> DataFrame:
    """(problem, cid) of a diversified beam for each problem. A problem's candidates are one step's children: tens."""
    g = df.groupBy(*problem).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(cid).cast("string").alias("c"), F.col(parent).cast("string").alias("p")))).alias("m"))

    def pick(members):
        rows = [(m["c"], m["p"], -m["s"]) for m in members]
        return diversify(rows[:width], rows[width:], floor)

    return g.select(*problem, F.explode(F.udf(pick, "array<string>")("m")).alias(cid))


def list_outcomes(items: DataFrame, group: list[str], key: str, score: str, rel: str, sigma: float = 1.0, alpha: float = 0.5, gap: float = 0.25) -> DataFrame:
    """A row for each list, from one sorted array of its items: ndcg, loss (null without a pair to order), right and all pairs across correctness, of speed, and of speed ``gap`` or more apart, rel of the first item by score and of the best one.

    rel is 0 for a wrong item, and 1 and a grade of speed for a right one. The one shuffle is by list: pairs are unfolded from a list's array, whose builder bounds it, and folded again where they stand. Ties of scores go to the smaller key and order no pair.
    """
    s, r = F.col(score).cast("double"), F.col(rel).cast("double")
    own = items.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct((-s).alias("z"), F.col(key).alias("k"), r.alias("r")))).alias("x"),
        F.sort_array(F.collect_list((-r).alias("z"))).alias("ideal"),
    )
    gain = lambda v: F.pow(F.lit(2.0), v) - 1
    off = lambda i: F.log2(i + 2.0)
    total = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda m, v: m + v)
    d = own.withColumns({"idcg": total("ideal", lambda v, i: gain(-v) / off(i)), "dcg": total("x", lambda v, i: gain(v["r"]) / off(i)), "top": F.col("x")[0]["r"], "best": -F.col("ideal")[0]})
    d = d.select(*group, "idcg", "dcg", "top", "best", "x", F.posexplode("x").alias("i", "a")).select("*", F.posexplode_outer(F.slice("x", F.col("i") + 2, F.size("x"))).alias("step", "b")).drop("x")
    a, b = F.col("a"), F.col("b")
    j = F.col("i") + F.col("step") + 1
    differ = b.isNotNull() & (a["r"] != b["r"])
    apart, low = F.abs(a["r"] - b["r"]), F.least(a["r"], b["r"])
    lead = F.when(a["r"] > b["r"], b["z"] - a["z"]).otherwise(a["z"] - b["z"])  # score of the better one less that of the other
    delta = F.when(differ & (F.col("idcg") > 0), F.abs(gain(a["r"]) - gain(b["r"])) * F.abs(1 / off(F.col("i")) - 1 / off(j)) / F.col("idcg"))
    cost = F.greatest(-sigma * lead, F.lit(0.0)) + F.log1p(F.exp(-F.abs(sigma * lead)))
    across, speed = differ & (low == 0), differ & (low > 0)
    mean = lambda side: F.try_divide(F.sum(F.when(side, delta * cost)), F.sum(F.when(side, delta)))
    count = lambda side: (F.count_if(side & (lead > 0)), F.count_if(side))
    sides = {"cross": across, "speed": speed, "big": speed & (apart >= gap)}
    pairs = [c.alias(f"{n}_{which}") for n, side in sides.items() for which, c in zip(("right", "all"), count(side), strict=True)]
    g = d.groupBy(*group).agg(*(F.first(c).alias(c) for c in ("idcg", "dcg", "top", "best")), mean(across).alias("across"), mean(speed).alias("of_speed"), *pairs)
    loss = F.coalesce(alpha * F.col("across") + (1 - alpha) * F.col("of_speed"), "across", "of_speed")
    return g.select(*group, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), loss.alias("loss"), "top", "best", *(f"{n}_{w}" for n in sides for w in ("right", "all")))


def evaluate_lists(outcomes: DataFrame) -> DataFrame:
    """One row from ``list_outcomes``: mean loss and NDCG, pooled pair accuracies, share of lists whose first item is right, the mean speed that it loses against the best one, and the mean share of the best speed that it has. What nothing counts for is 0."""
    c = F.col
    picked, most = F.greatest(c("top") - 1, F.lit(0.0)), c("best") - 1
    share = lambda n, d: F.coalesce(F.try_divide(F.sum(n), F.sum(d)), F.lit(0.0))
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    return outcomes.agg(
        F.count(F.lit(1)).alias("lists"),
        mean("loss").alias("list_loss"),
        mean("ndcg").alias("ndcg_graded"),
        share("speed_right", "speed_all").alias("speed_pair_acc"),
        share("big_right", "big_all").alias("speed_pair_acc_big"),
        share("cross_right", "cross_all").alias("correctness_pair_acc"),
        mean((c("top") > 0).cast("double")).alias("top1_correct"),
        mean(F.when(c("best") > 0, most - picked)).alias("speed_regret_at1"),
        mean(F.when(most > 0, picked / most)).alias("fast_at1"),
    )
