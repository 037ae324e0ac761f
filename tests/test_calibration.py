"""Calibration against a plain version: bands, pooling, offsets, shrinkage and the joint fit."""

import numpy as np
import pytest

from tallyloom.operators import calibration as C


def plain_curve(x, y, n_bands):
    edges = np.quantile(x, np.linspace(0, 1, n_bands + 1))[1:-1]
    band = np.searchsorted(edges, x, side="right")
    groups = [(x[band == b].mean(), y[band == b]) for b in np.unique(band)]
    return [g[0] for g in groups], C.pool_adjacent([g[1].mean() for g in groups])


def plain_solve(s, t, kx, ky, clamp):
    f = lambda c: np.interp(s + c, kx, ky).sum() - t.sum()
    if f(-clamp) >= 0:
        return -clamp, True
    if f(clamp) <= 0:
        return clamp, True
    lo, hi = -clamp, clamp
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2, False


def plain_joint(rows, rounds, n_bands, clamp):
    state, tau2 = {}, None
    s, t, p = (np.array([r[i] for r in rows], float) for i in (2, 3, 1))
    for k in range(rounds):
        kx, ky = plain_curve(s + np.array([state.get(i, 0.0) for i in p]), t, n_bands)
        raw, var, hit = {}, {}, {}
        for i in np.unique(p):
            raw[i], hit[i] = plain_solve(s[p == i], t[p == i], kx, ky, clamp)
            q = np.interp(s[p == i] + raw[i], kx, ky)
            info = (q * (1 - q)).sum()
            var[i] = 1 / info if info > 0 else 1e6
        core = [i for i in raw if not hit[i] and var[i] < 1e6]
        if tau2 is None and len(core) >= 2:
            tau2 = max(0.0, np.var([raw[i] for i in core]) - np.mean([var[i] for i in core]))
        shrink = {i: (1.0 if i in core else 0.0) if tau2 is None else tau2 / (tau2 + var[i]) for i in raw}
        c = {i: raw[i] * shrink[i] for i in raw}
        moves = sorted(abs(c[i] - state.get(i, 0.0)) for i in c)
        state = {i: state.get(i, 0.0) + 0.5 * (c[i] - state.get(i, 0.0)) if k else c[i] for i in c}
        if moves[-1 - int(0.01 * len(moves))] < 0.01:
            break
    return kx, ky, c


def anchors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "level long, problem_id long, score double, target double" + extra)


def test_joint_fit_against_plain(spark):
    rng = np.random.RandomState(5)
    rows = []
    for p in range(25):
        shift = rng.randn()
        for _ in range(12):
            s = rng.randn()
            rows.append((1, p, float(s), float(rng.rand() < 1 / (1 + np.exp(-3 * (s + shift))))))
    curve, offsets = C.fit_joint(anchors(spark, rows), rounds=4, n_bands=6)
    kx, ky, want = plain_joint(rows, 4, 6, 3.0)
    assert np.allclose(curve.x, kx) and np.allclose(curve.y, ky)
    got = {r["problem_id"]: r["c"] for r in offsets.collect()}
    assert np.allclose([got[int(i)] for i in want], list(want.values()), atol=1e-9)
    meta = C.offsets_meta(offsets).first()
    assert meta["n_problems"] == 25 and 0 < meta["n_informative"] <= 25 and np.isclose(meta["c_std"], np.std(list(want.values())))


def test_one_informative_problem_keeps_its_offset(spark):
    curve = C.Curve([-1.0, 1.0], [0.0, 1.0], [0.0, 0.0], [1, 1])
    rows = [(1, 1, -0.4, 0.5), (1, 1, 0.0, 0.5), (1, 2, 0.0, 0.0), (1, 3, 0.0, 1.0)]
    o = {r["problem_id"]: r for r in C.fit_offsets(anchors(spark, rows), curve).collect()}
    assert o[1]["shrink"] == 1.0 and np.isclose(o[1]["c"], 0.2) and not o[1]["clamped"]
    # a sum of 0 or 1 is met at an end of the curve, where it says nothing
    assert all(o[p]["c"] == 0.0 and o[p]["shrink"] == 0.0 and o[p]["var"] == 1e6 for p in (2, 3)) and o[2]["raw"] == -3.0 and o[2]["clamped"]
    k = {r["problem_id"]: r["shrink"] for r in C.fit_offsets(anchors(spark, rows), curve, kappa=2.0).collect()}
    assert k == {1: 0.5, 2: 1 / 3, 3: 1 / 3}
    assert [r["shrink"] for r in C.fit_offsets(anchors(spark, rows), curve, tau2=0.0).collect()] == [0.0] * 3


def test_curves_leave_out_what_the_scorer_has_seen(spark):
    rows = [(1, 1, float(s), s / 10, s % 2 == 0) for s in range(10)]
    a = anchors(spark, rows, ", orm_seen boolean")
    assert sum(C.fit_curve(a, n_bands=2).n) == 5 and sum(C.fit_curve(a, n_bands=2, orm_seen=True).n) == 10
    with pytest.raises(ValueError, match="no anchors"):
        C.fit_curve(a.where("orm_seen"), n_bands=2)


def test_settled_ignores_the_largest_hundredth(spark):
    moves = lambda n, far: spark.createDataFrame([(0.5 if i < far else 0.001,) for i in range(n)], "move double")
    assert C.settled(moves(100, 1)) and not C.settled(moves(99, 1)) and not C.settled(moves(100, 2)) and C.settled(moves(10, 0))


def test_curves_are_stored_and_refused():
    c = C.Curve([0.0, 1.0], [0.1, 0.9], [0.01, 0.02], [5, 6])
    assert C.from_dict(C.to_dict(c)) == c and C.usable(c) is c and C.curve_flags(c) == []
    flat = C.Curve([0.0, 0.0], [0.1, 0.9], [0.0, 0.0], [5, 6])
    assert len(C.curve_flags(flat)) == 2
    for curve, kw in ((flat, {}), (c, {"label_source": "measured"}), (c, {"scored_by": {"a", "b"}, "fitted_by": "a"})):
        with pytest.raises(ValueError, match="cannot label"):
            C.usable(curve, **kw)
    with pytest.raises(ValueError, match="as many knots"):
        C.from_dict({"knots_x": [1.0], "knots_y": [], "resid_var_by_band": [0.1]})


def test_validation_against_measured_values(spark):
    rng = np.random.RandomState(9)
    rows, scores, measured = [], [], []
    for p in range(16):
        shift = 1.5 * rng.randn()
        rows += [(1, p, float(s), float(rng.rand() < 1 / (1 + np.exp(-4 * (s + shift))))) for s in rng.randn(14)]
        for x in range(3):
            own = rng.randn(4)
            scores += [(1, p, p * 10 + x, float(s)) for s in own]
            measured.append((p * 10 + x, p, x % 2, float(np.mean(1 / (1 + np.exp(-4 * (own + shift)))))))
    a = anchors(spark, rows)
    s = spark.createDataFrame(scores, "level long, problem_id long, prefix_id long, score double")
    m = spark.createDataFrame(measured, "prefix_id long, list_key long, band int, m double")
    e = C.ablations(a, s, m, ["prefix_id"], n_bands=5)
    assert set(e) == {"joint", "no_offset", "one_round", "fixed_kappa"} and e["joint"] < e["no_offset"] < 0.5
    draws = C.stability(a, s, m, ["prefix_id"], 8, repeats=2, n_bands=5)
    assert [d["n"] for d in draws] == [48, 48] and all(0 < d["cal_error"] < 0.5 for d in draws) and C.core_sample(a, 8, 1).select("problem_id").distinct().count() == 8
    curve, offsets = C.fit_joint(a, n_bands=5)
    v = C.impute(s, curve, offsets, ["prefix_id"])
    overall, by_band = C.compare(m, v, ["prefix_id"], "list_key", "band", 0.2)
    got = {r["prefix_id"]: r["v"] for r in v.collect()}
    assert np.isclose(overall.first()["cal_error"], np.mean([abs(got[i] - x) for i, *_, x in measured])) and by_band.count() == 2
    pairs = [(i, j) for i in measured for j in measured if i[0] < j[0] and i[1] == j[1] and abs(i[3] - j[3]) > 0.2]
    assert overall.first()["n_pairs"] == len(pairs) and np.isclose(overall.first()["agreement"], np.mean([(i[3] > j[3]) == (got[i[0]] > got[j[0]]) for i, j in pairs]))
    out = C.summary(curve, offsets, a.select("level", (a.problem_id + 1).alias("problem_id")))
    assert out["flags"] == [] and len(out["bands"]) == 5 and out["offsets"]["n_problems"] == 16 and out["offsets"]["no_anchor_rate"] == 100 / 16


def test_problems_stay_in_their_rows(spark):
    """Offsets and imputed values are worked out in a problem's row: no turn is a row, nothing is sorted in a window, and the values are those of rows."""
    rng = np.random.RandomState(3)
    rows = [(1, p, float(s), float(rng.rand() < 0.5)) for p in range(30) for s in rng.randn(1 + p % 7)] + [(2, 1, None, 1.0), (2, 1, 0.3, 0.0), (2, 2, None, 1.0)]
    a = anchors(spark, rows)
    curve = C.Curve([-1.0, -0.2, 0.4, 1.5], [0.1, 0.3, 0.3, 0.9], [0.1, 0.2, 0.3, 0.4], [5] * 4)
    g = C.by_problem(a)
    plan = C.solve_offsets(g, curve)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Join" not in plan
    o = C.fit_grouped(g, curve)
    got = {(r["level"], r["problem_id"]): r for r in o.collect()}
    for p in range(30):
        s, t = (np.array([r[i] for r in rows if r[:2] == (1, p)]) for i in (2, 3))
        raw, hit = plain_solve(s, t, curve.x, curve.y, 3.0)
        q = np.interp(s + got[1, p]["raw"], curve.x, curve.y)
        assert got[1, p]["clamped"] == hit and np.isclose(np.interp(s + got[1, p]["raw"], curve.x, curve.y).sum(), np.interp(s + raw, curve.x, curve.y).sum()) and np.isclose(got[1, p]["var"], 1 / (q * (1 - q)).sum())
    assert got[2, 1]["n"] == 2 and got[2, 2]["n"] == 1 and got[2, 2]["var"] == 1e6
    one, two = (sorted(map(tuple, d.collect())) for d in (C.impute(a, curve, o, C.PROBLEM), C.impute_problems(o, curve)))
    assert len(one) == len(two) == 32 and all(x[:2] == y[:2] and x[4] == y[4] for x, y in zip(one, two, strict=True))
    assert all((x[2] is None) == (y[2] is None) and (x[2] is None or np.allclose(x[2:4], y[2:4])) for x, y in zip(one, two, strict=True))
