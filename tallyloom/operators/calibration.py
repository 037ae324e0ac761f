"""Monotone calibration curves, per-problem offsets with shrinkage, and imputed values."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .build import quantiles

PROBLEM = ["level", "problem_id"]
#: The variance of an offset that the curve says nothing about; when offsets have settled, and the share of problems that need not; the damping; points that a band needs for a variance of its own.
NO_INFO, TOLERANCE, TAIL, DAMP, MIN_BAND = 1e6, 0.01, 0.01, 0.5, 2


@dataclass
class Curve:
    """Knots of a non-decreasing curve, with the residual variance and size of each band: a bounded model, shipped as literals."""

    x: list[float]
    y: list[float]
    var: list[float]
    n: list[int]

    def __call__(self, v: float) -> float:
        if v <= self.x[0]:
            return self.y[0]
        if v >= self.x[-1]:
            return self.y[-1]
        i = bisect.bisect_right(self.x, v)
        a, b = self.x[i - 1], self.x[i]
        return self.y[i - 1] + (self.y[i] - self.y[i - 1]) * (v - a) / (b - a)

    def values(self, v: np.ndarray) -> np.ndarray:
        """The same for an array; nan stays."""
        x, y = np.array(self.x), np.array(self.y)
        i = np.searchsorted(x, v)  # the first knot that is not below
        k = np.clip(i, 1, max(1, len(x) - 1))
        a, b = np.minimum(k - 1, len(x) - 1), np.minimum(k, len(x) - 1)
        run = x[b] - x[a]
        on = y[a] + (y[b] - y[a]) * np.divide(v - x[a], run, out=np.zeros(np.shape(v)), where=run > 0)
        return np.where(np.isnan(v), np.nan, np.where(i == 0, y[0], np.where(i == len(x), y[-1], on)))

    def column(self, v: Column) -> Column:
        """The same as a column: linear between knots, flat outside."""
        out = F.when(v <= self.x[0], F.lit(self.y[0]))
        for a, b, p, q in zip(self.x, self.x[1:], self.y, self.y[1:], strict=False):
            out = out.when(v <= b, F.lit(p) + F.lit(q - p) * (v - F.lit(a)) / F.lit(b - a))
        return F.when(v.isNotNull(), out.otherwise(F.lit(self.y[-1])))


def bands(anchors: DataFrame, score: str, n_bands: int) -> DataFrame:
    """``anchors`` with ``band``: inner edges at linear quantiles; equal scores share a band."""
    qs = [i / n_bands for i in range(1, n_bands)]
    band = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in quantiles(anchors, score, qs)), F.lit(0))
    return anchors.withColumn("band", band.cast("int"))


def pool_adjacent(ys: list[float]) -> list[float]:
    """Least-squares non-decreasing fit with equal weights."""
    blocks: list[list[float]] = []
    for y in ys:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, m), (b, n) = blocks[-2], blocks[-1]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    return [b for b, n in blocks for _ in range(int(n))]


def fit_sample(anchors: DataFrame, orm_seen: bool = False) -> DataFrame:
    """The anchors that a curve is fitted to: those that the scorer has not been trained on (column ``orm_seen``, where there is one), or all if ``orm_seen``."""
    return anchors if orm_seen or "orm_seen" not in anchors.columns else anchors.where(~F.coalesce("orm_seen", F.lit(False)))


def fit_curve(anchors: DataFrame, score: str = "score", target: str = "target", n_bands: int = 10, orm_seen: bool = False) -> Curve:
    """Band means pooled to be monotone; residual variances about the fitted knot, bands of under two points get the pooled mean."""
    b = bands(fit_sample(anchors, orm_seen), score, n_bands).groupBy("band").agg(F.avg(score).alias("x"), F.avg(target).alias("y"), F.avg(F.col(target) * F.col(target)).alias("yy"), F.count(F.lit(1)).alias("n"))
    rows = sorted(b.collect(), key=lambda r: r["band"])  # n_bands rows
    if not rows:
        raise ValueError("no anchors to fit a curve to that the scorer has not seen")
    fit = pool_adjacent([r["y"] for r in rows])
    var = [max(0.0, r["yy"] - 2 * f * r["y"] + f * f) if r["n"] >= MIN_BAND else None for r, f in zip(rows, fit, strict=True)]
    known = [v for v in var if v is not None]
    fill = sum(known) / len(known) if known else 0.0
    return Curve([r["x"] for r in rows], fit, [fill if v is None else v for v in var], [r["n"] for r in rows])


def by_problem(anchors: DataFrame) -> DataFrame:
    """(problem, anchors): each problem's anchors, tens, in one row, so that what is worked out for a problem needs one shuffle."""
    return anchors.groupBy(*PROBLEM).agg(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), F.col("target").cast("double").alias("target"))).alias("anchors"))


def solve_offsets(grouped: DataFrame, curve: Curve, clamp: float = 3.0) -> DataFrame:
    """``by_problem`` with n, raw, var, clamped: the least shift within +-clamp that makes a problem's curve values sum to its targets (an end where none does), and the variance that the curve's slope there leaves it.

    The sum is linear between the shifts that bring a score onto a knot. Running sums of the changes of slope, in order of these shifts, give its value at each, so the shift is read off the one stretch in which the sum passes the targets.
    """

    @F.pandas_udf("raw double, var double, clamped boolean")
    def solved(score: pd.Series, target: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_by_width(lambda s, t: _solve(s, t, curve, clamp), score, target), columns=["raw", "var", "clamped"]).astype({"clamped": "bool"})

    d = grouped.withColumns({"n": F.size("anchors").cast("long"), "_o": solved("anchors.score", "anchors.target")})
    return d.select(*PROBLEM, "n", "_o.raw", "_o.var", "_o.clamped", "anchors")


#: Anchors whose turns a task holds at once, beside a single problem's.
MAX_ANCHORS = 1 << 16


def _by_width(fn, *columns: pd.Series) -> np.ndarray:
    """Rows of three numbers that ``fn`` gives for problems of as many anchors each: a matrix for a column of arrays, a single column for one of numbers."""
    width, columns = np.array([len(x) for x in columns[0]]), [c.to_numpy() for c in columns]
    out = np.empty((len(width), 3))
    for k in np.unique(width):
        who = np.flatnonzero(width == k)
        for part in np.array_split(who, -(-len(who) * max(1, k) // MAX_ANCHORS)):
            out[part] = np.column_stack(fn(*(np.array(list(c[part]), dtype="float64").reshape(len(part), -1) for c in columns)))
    return out


def _solve(s: np.ndarray, t: np.ndarray, curve: Curve, clamp: float) -> tuple[np.ndarray, ...]:
    """(raw, var, clamped) of problems, a row of scores and of targets each. An anchor without a score (nan) counts, but moves no sum."""
    x, y = np.array(curve.x), np.array(curve.y)
    rise, run = np.diff(y), np.diff(x)
    slope = np.divide(rise, run, out=np.zeros(len(run)), where=run > 0)
    total = lambda v: np.where(np.isnan(v).all(1), np.nan, np.nansum(v, 1))
    sums, base, rows = np.nansum(t, 1), s.shape[1] * y[0], np.arange(len(s))
    low, high = total(curve.values(s - clamp)), total(curve.values(s + clamp))
    c = (x - s[:, :, None]).reshape(len(s), -1)
    order = np.argsort(c, axis=1, kind="stable")  # nan last
    c, turn = np.take_along_axis(c, order, 1), np.tile(np.diff([0.0, *slope, 0.0]), s.shape[1])[order]
    m, o = np.zeros_like(c), np.zeros_like(c)  # before each turn
    m[:, 1:], o[:, 1:] = np.cumsum(turn, 1)[:, :-1], np.cumsum(turn * c, 1)[:, :-1]
    passed = base + m * c - o >= sums[:, None]
    j = passed.argmax(1)
    m, o, start, end = m[rows, j], o[rows, j], c[rows, np.maximum(j - 1, 0)], c[rows, j]
    at = np.divide(sums - base + o, m, out=start.copy(), where=m != 0)
    at = np.where(passed.any(1), np.minimum(np.maximum(at, start), end), clamp)
    ends = (low >= sums) | (high <= sums)
    raw = np.where(low >= sums, -clamp, np.where(high <= sums, clamp, at))
    q = curve.values(s + raw[:, None])
    info = np.nansum(q * (1 - q), 1)
    return raw, np.divide(1.0, info, out=np.full(len(s), NO_INFO), where=info > 0), ends


def spread(o: DataFrame) -> float | None:
    """The variance of true offsets: that of the solved ones less their own, over problems that are neither clamped nor without information; None under two of them."""
    m = o.where(f"NOT clamped AND var < {NO_INFO}").agg(F.count(F.lit(1)).alias("k"), F.var_pop("raw").alias("v"), F.avg("var").alias("m")).first()
    return max(0.0, m["v"] - m["m"]) if m["k"] >= 2 else None


def shrunk(o: DataFrame, tau2: float | None, kappa: float | None = None) -> DataFrame:
    """``o`` with shrink and c: n / (n + kappa), or tau2 / (tau2 + var); without an estimate the one problem that is identified keeps its offset and all others get 0."""
    if kappa is not None:
        shrink = F.col("n") / (F.col("n") + kappa)
    elif tau2 is None:
        shrink = F.when(~F.col("clamped") & (F.col("var") < NO_INFO), 1.0).otherwise(0.0)
    else:
        shrink = F.when(F.lit(tau2) + F.col("var") > 0, F.lit(tau2) / (F.lit(tau2) + F.col("var"))).otherwise(0.0)
    return o.withColumn("shrink", shrink).withColumn("c", F.col("raw") * F.col("shrink"))


def fit_offsets(anchors: DataFrame, curve: Curve, clamp: float = 3.0, kappa: float | None = None, tau2: float | None = None) -> DataFrame:
    """(problem, n, raw, var, clamped, shrink, c) of every problem with anchors, memorised ones included. ``tau2``: use this spread instead of estimating it."""
    return fit_grouped(by_problem(anchors), curve, clamp, kappa, tau2).drop("anchors")


def fit_grouped(grouped: DataFrame, curve: Curve, clamp: float = 3.0, kappa: float | None = None, tau2: float | None = None) -> DataFrame:
    """``fit_offsets`` of ``by_problem``, each problem with its anchors."""
    # one row a problem; read twice, for the spread and for the result
    o = written(solve_offsets(grouped, curve, clamp), "offsets")
    if kappa is None and tau2 is None:
        tau2 = spread(o)
    return shrunk(o, tau2, kappa)


def offsets_meta(o: DataFrame) -> DataFrame:
    """One row: counts and spreads of fitted offsets."""
    core = ~F.col("clamped") & (F.col("var") < NO_INFO)
    return o.agg(
        F.count(F.lit(1)).alias("n_problems"),
        F.coalesce(F.stddev_pop("c"), F.lit(0.0)).alias("c_std"),
        F.coalesce(F.stddev_pop(F.when(~F.col("clamped"), F.col("c"))), F.lit(0.0)).alias("c_std_core"),
        F.count_if("clamped").alias("n_clamped"),
        F.count_if(F.col("var") >= NO_INFO).alias("n_no_info"),
        F.count_if(core).alias("n_informative"),
        F.coalesce(F.try_divide(F.count_if(core), F.count(F.lit(1))), F.lit(0.0)).alias("frac_informative"),
        F.coalesce(F.avg("shrink"), F.lit(0.0)).alias("shrink_mean"),
    )


def step(state: DataFrame, new: DataFrame, damp: bool) -> DataFrame:
    """(problem, c, move): the offsets' next state, half of the way to the new solve if ``damp``, and how far the solve is from the last state."""
    old = state.select(*PROBLEM, F.col("c").alias("old"))
    d = new.select(*PROBLEM, "c").join(old, PROBLEM, "left").withColumn("old", F.coalesce("old", F.lit(0.0)))
    c = F.col("old") + DAMP * (F.col("c") - F.col("old")) if damp else F.col("c")
    return d.select(*PROBLEM, c.alias("c"), F.abs(F.col("c") - F.col("old")).alias("move"))


def settled(moves: DataFrame, tolerance: float = TOLERANCE) -> bool:
    """Whether all moves but the largest hundredth are under the tolerance."""
    m = moves.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("move") >= tolerance).alias("far")).first()
    return m["far"] <= int(TAIL * m["n"])


def fit_joint(anchors: DataFrame, rounds: int = 16, n_bands: int = 10, clamp: float = 3.0, kappa: float | None = None, orm_seen: bool = False) -> tuple[Curve, DataFrame]:
    """Curve and offsets in turn until the offsets settle.

    The spread of offsets is estimated once, in the first round: applying offsets takes
    away what it is estimated from. The state that the curve is fitted to moves half of the way to each
    new solve from the second round on; what is returned is the last solve itself, against the curve returned. Offsets
    are one row a problem; each round writes them to the checkpoint folder.
    """
    state, tau2 = None, None
    grouped = written(by_problem(anchors), "anchors")  # read in each round
    for k in range(max(1, rounds)):
        a = anchors if state is None else anchors.join(state.select(*PROBLEM, "c"), PROBLEM, "left").withColumn("score", F.col("score") + F.coalesce("c", F.lit(0.0))).drop("c")
        curve = fit_curve(a, n_bands=n_bands, orm_seen=orm_seen)
        solved = _cut(solve_offsets(grouped, curve, clamp).drop("anchors"))
        if tau2 is None and kappa is None:
            tau2 = spread(solved)
        new = shrunk(solved, tau2, kappa)
        state = _cut(step(state if state is not None else new.select(*PROBLEM, F.lit(0.0).alias("c")), new, damp=k > 0))
        if settled(state):
            break
    return curve, new


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session names a folder; else the plan as it stands, kept."""
    return df.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df.cache()


def impute(scores: DataFrame, curve: Curve, offsets: DataFrame | None, by: list[str]) -> DataFrame:
    """(by, v, se, n): mean of the curve at score + offset, and an error whose residual part is not divided by n."""
    s = scores if offsets is None else scores.join(offsets.select(*PROBLEM, "c"), PROBLEM, "left")
    x = F.col("score") + (F.coalesce("c", F.lit(0.0)) if offsets is not None else F.lit(0.0))
    band = F.least(F.greatest(sum(F.when(x >= k, 1).otherwise(0) for k in curve.x) - 1, F.lit(0)), F.lit(len(curve.x) - 1))
    s = s.withColumns({"_v": curve.column(x), "_var": F.get(F.array(*map(F.lit, curve.var)), band)})
    return s.groupBy(*by).agg(F.avg("_v").alias("v"), F.sqrt(F.var_pop("_v") / F.count(F.lit(1)) + F.avg("_var")).alias("se"), F.count(F.lit(1)).alias("n"))


def impute_problems(o: DataFrame, curve: Curve) -> DataFrame:
    """``impute`` of the anchors that stand in the rows of their problems, by problem, at the offsets c beside them: nothing is joined or grouped."""

    @F.pandas_udf("v double, se double, n double")
    def imputed(score: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_by_width(lambda s, k: _mean(s + k, curve), score, c), columns=["v", "se", "n"])

    return o.withColumn("_v", imputed("anchors.score", "c")).select(*PROBLEM, "_v.v", "_v.se", F.col("_v.n").cast("long").alias("n"))


def _mean(x: np.ndarray, curve: Curve) -> tuple[np.ndarray, ...]:
    """(v, se, n) of problems, a row of shifted scores each; nan where no score is."""
    v, some = curve.values(x), np.maximum((~np.isnan(x)).sum(1), 1)
    band = np.where(np.isnan(x), 0, np.clip(np.searchsorted(curve.x, x, side="right") - 1, 0, len(curve.x) - 1))
    mean = np.where(np.isnan(x).all(1), np.nan, np.nansum(v, 1) / some)
    var = np.nansum((v - mean[:, None]) ** 2, 1) / some
    return mean, np.sqrt(np.where(np.isnan(mean), np.nan, var) / x.shape[1] + np.array(curve.var)[band].mean(1)), np.full(len(x), x.shape[1])


def curve_flags(curve: Curve) -> list[str]:
    """What is wrong with a curve, for a report that must stay legible; ``usable`` refuses the same."""
    out = []
    if any(a >= b for a, b in zip(curve.x, curve.x[1:], strict=False)):
        out.append("knots do not ascend")
    if curve.var and all(v == 0.0 for v in curve.var):
        out.append("no band has a residual variance")
    return out


def usable(curve: Curve, label_source: str = "imputed", scored_by: set[str] = frozenset(), fitted_by: str | None = None) -> Curve:
    """``curve``, or an error: it must ascend, have measured its residuals, be fitted to label (not to validate), and stem from the checkpoint that scored the rollouts."""
    flags = curve_flags(curve)
    if label_source != "imputed":
        flags.append(f"it was fitted under label source {label_source!r}")
    if fitted_by is not None and set(scored_by) - {fitted_by}:
        flags.append(f"rollouts were scored by {sorted(scored_by)}, the curve by {fitted_by!r}")
    if flags:
        raise ValueError(f"the curve cannot label: {'; '.join(flags)}")
    return curve


def to_dict(curve: Curve) -> dict:
    return {"knots_x": list(curve.x), "knots_y": list(curve.y), "resid_var_by_band": list(curve.var), "n_by_band": list(curve.n), "n_fit": sum(curve.n)}


def from_dict(d: dict) -> Curve:
    """A curve from its stored form; lists of different lengths, or none, are errors."""
    x, y, var = d["knots_x"], d["knots_y"], d["resid_var_by_band"]
    if not x or not len(x) == len(y) == len(var):
        raise ValueError("a curve needs as many knots as values and variances, and one at least")
    return Curve(list(x), list(y), list(var), list(d.get("n_by_band") or [0] * len(x)))


def compare(measured: DataFrame, imputed: DataFrame, key: list[str], list_key: str, band: str, gap: float) -> tuple[DataFrame, DataFrame]:
    """(overall, by band): mean absolute error and agreement of pairs over ``gap`` apart within lists, of imputed values (v) against measured ones (m)."""
    from .campaign import calibration_error
    from .ranking import pair_agreement

    d = measured.join(imputed, key)
    both = d.where("m IS NOT NULL AND v IS NOT NULL")
    overall = calibration_error(both, "m", "v").crossJoin(F.broadcast(pair_agreement(both, [list_key], key[0], "m", "v", gap)))  # one row each
    return overall, calibration_error(both, "m", "v", [band])


def core_sample(anchors: DataFrame, n: int, seed: int) -> DataFrame:
    """The anchors of ``n`` problems by a hash of their keys."""
    from ..functions.labels import hash_order

    chosen = anchors.select(*PROBLEM).distinct().orderBy(hash_order(seed, *map(F.col, PROBLEM)), *PROBLEM).limit(n)
    return anchors.join(chosen, PROBLEM, "left_semi")


def stability(anchors: DataFrame, scores: DataFrame, measured: DataFrame, by: list[str], n: int, seed: int = 0, repeats: int = 3, n_bands: int = 10) -> list[dict]:
    """For ``repeats`` draws of ``n`` problems to fit the curve to: its error against measured values (by, m), every problem having its own offset from all of its anchors. One row a draw."""
    out = []
    for r in range(repeats):
        curve = fit_curve(core_sample(anchors, n, seed * 1000 + r), n_bands=n_bands)
        v = impute(scores, curve, fit_offsets(anchors, curve), by)
        e = measured.join(v, by).agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("e"), F.count(F.lit(1)).alias("n")).first()
        out.append({"draw": r, "cal_error": e["e"], "n": e["n"]})
    return out


def ablations(anchors: DataFrame, scores: DataFrame, measured: DataFrame, by: list[str], n_bands: int = 10) -> dict[str, float]:
    """Error against measured values of the joint fit, of the curve without offsets, of a single round, and of a fixed shrinkage."""

    def error(curve, offsets):
        v = impute(scores, curve, offsets, by)
        return measured.join(v, by).agg(F.avg(F.abs(F.col("v") - F.col("m")))).first()[0]

    return {
        "joint": error(*fit_joint(anchors, n_bands=n_bands)),
        "no_offset": error(fit_curve(anchors, n_bands=n_bands), None),
        "one_round": error(*fit_joint(anchors, rounds=1, n_bands=n_bands)),
        "fixed_kappa": error(*fit_joint(anchors, n_bands=n_bands, kappa=8.0)),
    }


def summary(curve: Curve, offsets: DataFrame, problems: DataFrame) -> dict:
    """A fit for a report: flags, bands, offsets and the share of the campaign's problems without any."""
    from .campaign import without_anchors

    meta = offsets_meta(offsets).first().asDict()
    n, lost = problems.select(*PROBLEM).distinct().count(), without_anchors(problems, offsets).count()
    bands_ = [{"band": i, "score": a, "target": b, "n": k} for i, (a, b, k) in enumerate(zip(curve.x, curve.y, curve.n, strict=True))]
    return {"flags": curve_flags(curve), "bands": bands_, "offsets": meta | {"clamp_rate": 100.0 * meta["n_clamped"] / meta["n_problems"] if meta["n_problems"] else 0.0, "no_anchor_rate": 100.0 * lost / n if n else None}}
