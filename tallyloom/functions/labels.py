"""Column expressions for labels, speedups, targets and bands. Null means unknown and is never turned into zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Truncation states of an attempt.
OK, TRUNCATED, UNKNOWN = "ok", "truncated", "unknown"


def status(compiled: Column, correct: Column) -> Column:
    return F.when(~F.coalesce(compiled, F.lit(False)), "not_compiled").when(~F.coalesce(correct, F.lit(False)), "incorrect").otherwise("compiled_and_correct")


def label(compiled: Column, correct: Column) -> Column:
    return (status(compiled, correct) == "compiled_and_correct").cast("int")


def usable(t: Column) -> Column:
    """A time that was measured: there, finite and above zero."""
    return F.coalesce((t > 0) & ~F.isnan(t) & (t < F.lit(float("inf"))), F.lit(False))


def speedup(correct: Column, ours: Column, baseline: Column) -> Column:
    """baseline / ours for correct candidates where both sides and the quotient are usable."""
    q = F.try_divide(baseline, ours)
    return F.when(F.coalesce(correct, F.lit(False)) & usable(ours) & usable(baseline) & usable(q), q)


def dataset_speedup(correct: Column, ours: Column, baseline: Column) -> Column:
    """The dataset's own rule: correct, a runtime above zero and a baseline; no test for finiteness."""
    return F.when(F.coalesce(correct, F.lit(False)) & F.coalesce(ours > 0, F.lit(False)), F.try_divide(baseline, ours))


def report_speedup(correct: Column, ours: Column, baseline: Column) -> Column:
    """The outcome report's rule: correct and a runtime other than zero, negative ones too."""
    return F.when(F.coalesce(correct, F.lit(False)) & F.coalesce(ours != 0, F.lit(False)), F.try_divide(baseline, ours))


def speed_p(s: Column, lo: float = 0.2, hi: float = 4.0, quant: float = 0.0) -> Column:
    """Place of log2(s) between log2(lo) and log2(hi), clamped to 0..1 and, with ``quant``, snapped half-even to its multiples."""
    span = F.log2(F.lit(hi)) - F.log2(F.lit(lo))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log2(s) - F.log2(F.lit(lo))) / span))
    if quant > 0:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(p / quant) * quant))
    return F.when(s.isNotNull(), p)


def graded_target(s: Column, **scale: float) -> Column:
    return (1 + speed_p(s, **scale)) / 2


def target(lab: Column, s: Column, mode: str = "graded", **scale: float) -> Column:
    """binary: the label; graded: 0 for label 0, else the graded speedup, null where it can't be graded."""
    if mode not in ("binary", "graded"):
        raise ValueError(f"mode {mode!r}")
    return lab.cast("double") if mode == "binary" else F.when(lab == 0, F.lit(0.0)).otherwise(graded_target(s, **scale))


def check_scale(mode: str, lo: float, hi: float, quant: float) -> None:
    if mode not in ("binary", "graded") or not 0 < lo < hi or not 0 <= quant <= 1:
        raise ValueError(f"bad target scale: {mode}, {lo}, {hi}, {quant}")


def truncation_state(trace: Column) -> Column:
    """From struct(passes int, plan_finish_reason, code_finish_reason): every needed pass must have stopped by itself."""
    passes = F.coalesce(trace["passes"], F.lit(2))
    plan, code = trace["plan_finish_reason"], trace["code_finish_reason"]
    unknown = trace.isNull() | ~passes.isin(1, 2) | code.isNull() | ((passes == 2) & plan.isNull())
    ok = (code == "stop") & ((passes == 1) | (plan == "stop"))
    return F.when(unknown, UNKNOWN).when(ok, OK).otherwise(TRUNCATED)


def band_edges(lo: float, hi: float, n: int) -> list[float]:
    return [round(lo + (hi - lo) * i / n, 6) for i in range(n + 1)]


def band_of(x: Column, edges: list[float]) -> Column:
    """Index of the band that holds x; the top band is closed and what lies outside goes to the end bands."""
    at_or_below = sum(F.when(x >= e, 1).otherwise(0) for e in edges)
    return F.when(x.isNotNull(), F.least(F.greatest(at_or_below - 1, F.lit(0)), F.lit(len(edges) - 2)))


def percent(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(100 * n, d), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def geo_mean(x: Column) -> Column:
    """Aggregate: the geometric mean of usable values, 0 without any."""
    return F.coalesce(F.exp(F.avg(F.when(x > 0, F.log(x)))), F.lit(0.0))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, else null: one pass for an ordered ladder of drops."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))


def hash_order(seed: int, *key: Column) -> Column:
    """A draw that depends on the row's identity alone, never on the order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))


def hash_uniform(seed: int, *key: Column) -> Column:
    return F.conv(F.substring(hash_order(seed, *key), 1, 12), 16, 10).cast("double") / float(1 << 48)


#: Fixed values of a 32-bit mix: the factor of its rounds, and steps that keep places of a draw apart.
MIX, ROUND_STEP, ITEM_STEP, LOW32 = 73244475, 2654435769, 40503, (1 << 32) - 1


def hash_seed(seed: int, *key: Column) -> Column:
    """32 bits of a row's identity, from which ``mixed_uniform`` draws: one digest for any number of draws."""
    return F.conv(F.substring(hash_order(seed, *key), 1, 8), 16, 10).cast("long")


def mixed_uniform(seed: Column, round_: Column, place: Column) -> Column:
    """A draw of round and place, in whole-number arithmetic that other engines have too."""
    x = (seed + round_ * ROUND_STEP + place * ITEM_STEP).bitwiseAND(F.lit(LOW32))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * MIX).bitwiseAND(F.lit(LOW32))
    return x.bitwiseXOR(F.shiftright(x, 16)).cast("double") / float(1 << 32)
