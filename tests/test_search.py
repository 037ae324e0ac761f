"""Guided search with a scripted backend, settings, and the command line."""

import json
import sys

import pytest
from pyspark import cloudpickle

from tallyloom import cli, config
from tallyloom.functions.sequences import CODE_FENCE, PLAN_PREFIX
from tallyloom.operators import search as S

# executors do not import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PLAN, BODY = "Use a kernel.\n", "\nimport torch\nx = 1\ny = 2\nclass ModelNew:\n    pass\n```\n"


def script(context, variant):
    """What remains of the one completion that this policy writes; variants of a fresh beam differ by a comment."""
    whole = PLAN_PREFIX + PLAN + CODE_FENCE + BODY
    text = context.split("|", 1)[1]
    return whole[len(text) :] if whole.startswith(text) else "\n```\n"


def count(text):
    return len(S.Scripted.tokens(text))


def make():
    return S.Scripted(script), lambda texts: [float(len(t)) for t in texts], count


def lazy():
    return S.Scripted(lambda context, i: " done"), lambda texts: [0.0] * len(texts), count


def branches():
    return S.Scripted(branching), lambda texts: [float(sum(map(ord, t)) % 101) for t in texts], count


def problems(spark, n):
    return spark.createDataFrame([(1, p, f"head{p}|", "prompt ") for p in range(n)], "level long, problem_id long, head string, prompt string")


def run(spark, n=1, how=make, callers=1, **kw):
    conf = config.Search(**{"beam_width": 2, "expand": 2, "max_steps": 12, "segment_max_tokens": 4, "max_new_tokens": 200} | kw)
    pool, steps = S.search(problems(spark, n), how, conf, config.Cuts(), callers=callers)
    return pool.orderBy("problem_id", "cid").collect(), steps.orderBy("problem_id", "step", "cid").collect()


def test_beam_reaches_the_end(spark):
    pool, steps = run(spark)
    assert pool and all(r["stop"] == S.EOS and r["text"] == PLAN_PREFIX + PLAN + CODE_FENCE + BODY and r["code"].startswith("import torch") for r in pool)
    by_step = {}
    for r in steps:
        by_step.setdefault(r["step"], []).append(r)
    assert len(by_step[0]) == 2 and all(len(x) <= 4 for x in by_step.values())
    assert all(sum(r["kept"] for r in x) <= 2 for x in by_step.values()) and all(r["score"] is None and not r["kept"] for r in steps if r["stop"])
    ids = [r["cid"] for r in steps]
    assert len(set(ids)) == len(ids) and {r["parent"] for r in steps if r["step"]} <= {r["cid"] for r in steps if r["kept"]}
    assert sorted(r["sample_id"] for r in pool) == list(range(len(pool)))


def test_steps_tokens_and_plans_end_rows(spark):
    assert [r["stop"] for r in run(spark, max_steps=1)[0]] == [S.STEPS, S.STEPS]
    assert {r["stop"] for r in run(spark, max_new_tokens=6)[0]} == {S.BUDGET}
    pool, steps = run(spark, how=lazy)
    assert {(r["stop"], r["code"], r["sample_id"]) for r in pool} == {(S.EOS_IN_PLAN, None, None)} and {r["step"] for r in steps} == {0}
    assert {r["stop"] for r in run(spark, two_pass=False, max_steps=2)[0]} == {S.STEPS}


def test_beam_by_cuts_stops_at_its_chunk(spark):
    _, steps = run(spark, advance="cuts", segment_max_tokens=12)
    ok = [r for r in steps if r["reached"] and not r["stop"]]
    assert ok and all(r["cut_char"] is not None for r in ok)
    assert len({r["cut_char"] for r in ok if r["step"] == 1}) == 1


def test_groups_parents_and_random_scores(spark):
    rows = [(1, 1, "c0", "a", 3.0, 0), (1, 1, "c1", "a", 2.0, 0), (1, 1, "c2", "b", 1.0, 0), (1, 2, "c0", "a", 3.0, 0), (1, 2, "c1", "a", 2.0, 0), (1, 2, "c2", "b", 1.0, 1)]
    d = spark.createDataFrame(rows, "level long, problem_id long, cid string, parent string, score double, group int")
    picked = lambda **kw: sorted((r["problem_id"], r["cid"]) for r in S.chosen(d, config.Search(beam_width=2, **kw)).collect())
    assert picked(min_distinct_parents=2) == [(1, "c0"), (1, "c2"), (2, "c0"), (2, "c1")] or picked(min_distinct_parents=2)[:2] == [(1, "c0"), (1, "c2")]
    assert picked(beam_groups=2) == [(1, "c0"), (2, "c0"), (2, "c2")]
    assert picked() == [(1, "c0"), (1, "c1"), (2, "c0"), (2, "c1"), (2, "c2")]
    assert run(spark, selector="random", max_steps=3) == run(spark, selector="random", max_steps=3)
    assert {r["group"] for r in run(spark, beam_width=4, beam_groups=2, max_steps=1)[1]} == {0, 1}


def branching(context, variant):
    """Completions that differ by problem and by variant, so that no two beams are alike."""
    head, text = context.split("|", 1)
    plan = f"Plan {head} " + "word " * (len(text) % 5 + 1) + "\n"
    whole = PLAN_PREFIX + plan + CODE_FENCE
    if CODE_FENCE not in text:
        return whole[len(PLAN_PREFIX) :] if text == PLAN_PREFIX else f"{variant} more\n" + CODE_FENCE
    return f"\nx{variant} = {len(text) % 7}\n" + ("```\n" if len(text) > 90 + 7 * variant else "y = 1\nz = 2\n" * 4)


def test_all_problems_together_as_each_alone(spark):
    """The pool of many problems is that of each by itself, and a step takes as many calls for many problems as for few."""
    how = branches
    kw = dict(beam_width=4, expand=3, max_steps=4, segment_max_tokens=7, max_new_tokens=40, min_distinct_parents=2)
    together, steps = run(spark, 5, how, **kw)
    dealt, _ = run(spark, 5, how, callers=3, **kw)  # siblings in different calls are other variants of the script
    assert {r["problem_id"] for r in dealt} == set(range(5)) and all(len({r["cid"] for r in dealt if r["problem_id"] == p}) == sum(r["problem_id"] == p for r in dealt) for p in range(5))
    conf = config.Search(**kw)
    for p in (0, 3):
        pool, _ = S.search(problems(spark, 5).where(f"problem_id = {p}"), how, conf, config.Cuts(), callers=1)
        assert pool.orderBy("cid").collect() == [r for r in together if r["problem_id"] == p]
    calls = []
    for n in (2, 40):
        asked = S.start(problems(spark, n), conf).selectExpr("level", "problem_id", "cid", "concat(head, text) AS context", "7 AS room")
        calls.append(S.answers(asked, how, 1.0, None, 1, 256).select("call").distinct().count())
    assert calls == [1, 1]


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"search": {"beam_width": 8}, "labels": {"speed_quant": 0.1}}))
    s = config.load(str(path), ["search.beam_groups=2", "search.two_pass=false", "campaign.k=7"])
    assert (s.search.beam_width, s.search.beam_groups, s.search.two_pass, s.campaign.k, s.labels.speed_quant) == (8, 2, False, 7, 0.1)
    assert config.flat(s)["search.beam_width"] == 8 and len(config.flat(s)) == len(config.flat(config.Settings()))
    for bad in ("search.beam_groups=3", "labels.speedup_lo=9", "campaign.min_rollouts=0", "search.advance=fast", "cuts.min_frac=1.5", "campaign.label_source=guess"):
        with pytest.raises(ValueError, match="bad setting"):
            config.load(overrides=[bad])
    with pytest.raises(KeyError):
        config.load(overrides=["search.width=3"])
    with pytest.raises(ValueError, match="neither"):
        config.load(overrides=["search.two_pass=maybe"])


def test_command_line(spark, sf, tmp_path):
    assert "fastp_report" in cli.main(["list"]).split("\n")
    out = cli.main(["run", "shard_ranges", sf, "--rows", "3"], spark)
    assert len(out.split("\n")) == 5 and out.split("\n")[0].split() == ["shard", "lo", "hi", "n"]
    assert "Physical Plan" in cli.main(["explain", "homes", sf], spark)
    assert spark.read.parquet(cli.main(["run", "homes", sf, "--out", str(tmp_path / "o")], spark)).count() > 0
    (tmp_path / "level_1_problem_2_sample_3_kernel.py").write_text("x = (\n")
    assert "syntax" in cli.main(["scan", str(tmp_path), "--out", str(tmp_path / "scan")], spark)
    assert json.loads(cli.main(["settings", "campaign.k=9"]))["campaign.k"] == 9
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such", sf], spark)
