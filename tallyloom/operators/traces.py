"""Token-level confidence: top-k packing, per-token scalars, sliding means and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack(tokens: DataFrame, alternatives: str, k: int) -> DataFrame:
    """``topk_ids`` and ``topk_lp``: alternatives (array of struct(id, lp)) by falling lp, first of each id, padded with -1 and -inf to k."""
    order = F.expr(f"array_sort({alternatives}, (a, b) -> CASE WHEN a.lp > b.lp THEN -1 WHEN a.lp < b.lp THEN 1 ELSE a.id - b.id END)")
    t = tokens.withColumn("_a", order).withColumn("_i", F.expr("transform(_a, x -> x.id)"))
    t = t.withColumn("_a", F.expr(f"slice(filter(_a, (x, i) -> array_position(_i, x.id) = i + 1), 1, {k})"))
    pad = f"greatest({k} - size(_a), 0)"
    t = t.withColumn("topk_ids", F.expr(f"concat(transform(_a, x -> cast(x.id as int)), array_repeat(-1, {pad}))"))
    return t.withColumn("topk_lp", F.expr(f"concat(transform(_a, x -> cast(x.lp as double)), array_repeat(double('-inf'), {pad}))")).drop("_a", "_i")


def scalars(tokens: DataFrame, lp: str = "topk_lp", vocab: int = 50_000) -> DataFrame:
    """entropy of the renormalised top-k, top1_lp, margin, deepconf (negative mean of finite lp), tail_mass and self_cert of each token."""
    t = tokens.withColumn("_f", F.expr(f"filter({lp}, x -> x > double('-inf'))")).withColumn("_p", F.expr("transform(_f, x -> exp(x))"))
    t = t.withColumn("_z", F.expr("aggregate(_p, 0D, (a, x) -> a + x)"))
    return t.withColumns(
        {
            "entropy": F.expr("aggregate(_p, 0D, (a, x) -> a - IF(x > 0, x / _z * ln(x / _z), 0D))"),
            "top1_lp": F.expr(f"{lp}[0]"),
            "margin": F.expr("_p[0] - coalesce(get(_p, 1), 0D)"),
            "deepconf": F.expr("-aggregate(_f, 0D, (a, x) -> a + x) / size(_f)"),
            "tail_mass": F.expr("least(greatest(1D - _z, 0D), 1D)"),
            "self_cert": F.expr(f"ln({vocab}) + aggregate(_p, 0D, (a, x) -> a + IF(x > 0, x * ln(x), 0D)) + IF(1 - _z > 0 AND {vocab} > size(_p), (1 - _z) * ln((1 - _z) / ({vocab} - size(_p))), 0D)"),
        }
    ).drop("_f", "_p", "_z")


def sliding_mean(tokens: DataFrame, by: list[str], pos: str, value: str, window: int) -> DataFrame:
    """(by, end position, mean) of every full window of min(window, n) tokens."""
    w = Window.partitionBy(*by).orderBy(pos)
    t = tokens.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(*by)), "_i": F.row_number().over(w)})
    run = [F.sum(value).over(w.rowsBetween(-(window - 1), 0)), F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), 0))]
    t = t.withColumns({"mean": run[0] / run[1]})
    return t.where(F.col("_i") >= F.least(F.lit(max(1, window)), F.col("_n"))).select(*by, pos, "mean")


def summary(tokens: DataFrame, by: list[str], pos: str, value: str, window: int) -> DataFrame:
    """n_tokens, c_mean, c_least (worst window), c_bottom10 (mean of the worst tenth of windows), c_tail (last window) of each trace."""
    m = sliding_mean(tokens, by, pos, value, window)
    w = Window.partitionBy(*by)
    m = m.withColumns({"_r": F.row_number().over(w.orderBy("mean", pos)), "_g": F.count(F.lit(1)).over(w), "_last": F.row_number().over(w.orderBy(F.col(pos).desc()))})
    low = F.greatest(F.lit(1), F.floor(F.col("_g") * 0.1))
    m = m.groupBy(*by).agg(F.min("mean").alias("c_least"), F.avg(F.when(F.col("_r") <= low, F.col("mean"))).alias("c_bottom10"), F.max(F.when(F.col("_last") == 1, F.col("mean"))).alias("c_tail"))
    return tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tokens"), F.avg(value).alias("c_mean")).join(m, by)


def rank1_calibration(tokens: DataFrame, lp: str = "topk_lp", rank: str = "sampled_rank") -> DataFrame:
    """Mean probability of the top alternative against the share of tokens that took it."""
    return tokens.agg(F.avg(F.exp(F.col(lp)[0])).alias("mean_p1"), F.avg((F.col(rank) == 1).cast("double")).alias("share_rank1"), F.count(F.lit(1)).alias("n"))
