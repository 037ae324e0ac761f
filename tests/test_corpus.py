"""Labelled attempts and the build of a corpus: the join, the ledger, resume and restarts."""

import json

import pytest

from tallyloom import cli
from tallyloom.config import Cuts, Labels
from tallyloom.sources import corpus, readers, runs, scans, sinks

STOP = {"passes": 1, "code_finish_reason": "stop"}
TEXT = "Plan\n```python\nimport torch\nx = 1\n```\n"


def attempt(p, s, raw=TEXT, trace=STOP, level=1, prompt="go"):
    return {"stem": f"p{p}_s{s}", "level": level, "problem_id": p, "sample_id": s, "system_prompt": "be brief", "prompt": prompt, "raw": raw, "trace": trace}


def unit(root, shard, attempts, verdicts):
    d = root / shard
    (d / "traces").mkdir(parents=True)
    (d / "kernels").mkdir()
    if attempts is not None:
        (d / "traces" / "attempts.jsonl").write_text("".join(json.dumps(a) + "\n" for a in attempts))
    if verdicts is not None:
        (d / "eval_results.json").write_text(json.dumps(verdicts))


def ok(s, runtime=2.0, **kw):
    return {"sample_id": s, "compiled": True, "correctness": True, "runtime": runtime, "runtime_stats": {"min": runtime / 2}} | kw


@pytest.fixture
def run(tmp_path):
    root = tmp_path / "run a+b"
    tries = [attempt(3, 0), attempt(3, 1), attempt(3, 2, trace={"passes": 2, "plan_finish_reason": "length", "code_finish_reason": "stop"}), attempt(3, 3, trace=None), attempt(3, 4), attempt(4, 0), attempt(5, 0), attempt(6, 0, raw="```py\nx = (\n"), attempt(3, 5, raw=TEXT + "word " * 500), attempt(3, 6), attempt(3, 7, raw="")]
    seen = {"3": [ok(0), {"sample_id": 1, "compiled": False}, ok(2), ok(3), ok(5), ok(6, -1.0), ok(7)], "4": [ok(0)], "5": [ok(0)], "6": [ok(0)]}
    unit(root, "shard_00", tries, seen)
    unit(root, "shard_01", [attempt(3, 0)], None)
    (tmp_path / "base.json").write_text(json.dumps({"level1": {f"{p}_Name.py": {"mean": 4.0, "min": 3.0} for p in (3, 4, 6)}}))
    (tmp_path / "out.json").write_text(json.dumps({"level1": [4]}))
    return root, tmp_path


def test_attempts_meet_their_verdicts(spark, run):
    root, _ = run
    d = corpus.labelled(spark, runs.units(spark, [str(root)]).where("skipped IS NULL"))
    got = {(r["problem_id"], r["sample_id"]): r for r in d.collect()}
    assert len(got) == 11 and [tuple(r)[2:] for r in corpus.attempt_counts(d).collect()] == [(11, 10, 1)]
    assert (got[3, 0]["runtime"], got[3, 0]["runtime_min"], got[3, 0]["correct"], got[3, 0]["truncation"]) == (2.0, 1.0, True, "ok")
    assert not got[3, 4]["matched"] and got[3, 1]["compiled"] is False and (got[3, 2]["truncation"], got[3, 3]["truncation"]) == ("truncated", "unknown")
    (root / "shard_00" / "traces" / "attempts.jsonl").open("a").write("{broken\n")
    with pytest.raises(Exception, match="not an attempt"):
        corpus.labelled(spark, runs.units(spark, [str(root)]).where("skipped IS NULL")).collect()


def build(spark, run, **kw):
    root, tmp = run
    return corpus.build_corpus(spark, [str(root)], str(tmp / "corpus"), str(tmp / "base.json"), str(tmp / "out.json"), **{"cuts": Cuts(max_length=300)} | kw)


def test_build_and_resume(spark, run):
    """Every attempt has a row or a reason; a second build takes what is there and builds what is new; other settings are refused."""
    root, tmp = run
    m = build(spark, run)
    want = {"rows": 2, "no_eval_entry": 1, "excluded": 1, "truncated": 1, "no_finish_reason": 1, "no_runtime": 1, "no_baseline": 1, "tokenize_failed": 1, "too_long": 1, "no_cuts": 1}
    assert {k: v for k, v in m["counts"].items() if k != "cuts"} == want and m["attempts"] == 11
    assert (m["units_built"], m["units_reused"], m["skipped_units"]) == (1, 0, [["run a+b", "shard_01", "no_eval_results"]])
    assert m["dropped_stems"]["excluded"] == ["p4_s0"] and m["dropped_stems"]["no_runtime"] == ["p3_s6"]
    rows = {r["stem"]: r for r in corpus.corpus_rows(spark, str(tmp / "corpus")).collect()}
    assert set(rows) == {"p3_s0", "p3_s1"} and rows["p3_s0"]["speedup"] == 2.0 and rows["p3_s0"]["speedup_min"] == 3.0 and rows["p3_s1"]["target"] == 0.0
    assert [(r[1]) for r in corpus.prompts(spark, str(tmp / "corpus")).collect()] == ["be brief"]
    (root / "shard_01" / "eval_results.json").write_text(json.dumps({"3": [ok(0)]}))
    again = build(spark, run)
    assert (again["units_built"], again["units_reused"], again["attempts"]) == (1, 1, 12) and corpus.corpus_rows(spark, str(tmp / "corpus")).count() == 3
    assert build(spark, run)["units_built"] == 0
    with pytest.raises(ValueError, match="built otherwise"):
        build(spark, run, labels=Labels(speedup_hi=9.0))
    (tmp / "base.json").write_text("{}")
    with pytest.raises(ValueError, match="built otherwise"):
        build(spark, run)


def test_a_killed_build_is_built_anew(spark, run, monkeypatch):
    """Parts without a record do not count: the next build replaces them."""
    _, tmp = run

    def dies(rows):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(corpus, "records_of", dies)
        with pytest.raises(RuntimeError, match="killed"):
            build(spark, run)
    assert sinks.exists(spark, str(tmp / "corpus" / "parts")) and not sinks.exists(spark, str(tmp / "corpus" / "records"))
    assert build(spark, run)["counts"]["rows"] == 2 and corpus.corpus_rows(spark, str(tmp / "corpus")).count() == 2


def test_gates_of_a_built_corpus(spark, run):
    """Each gate by what it is there to catch."""
    root, tmp = run
    out = str(tmp / "corpus")
    build(spark, run)
    splits = spark.createDataFrame([(1, 3, "train")], "level int, problem_id long, split string")
    gates = lambda **kw: {r["check"]: r["ok"] for r in corpus.corpus_checks(spark, out, [str(root)], **{"cuts": Cuts(max_length=300), "splits": splits} | kw).collect()}
    first = gates()
    failed = {k for k, ok in first.items() if not ok}
    assert len(first) == 13 and failed == {"base-rate shift under 0.5 points", "no attempt is missing its verdict"}
    assert not gates(cuts=Cuts())["report config matches the build's"] and not gates(splits=None)["every problem has a split"] and not gates(splits=splits.limit(0))["every problem has a split"]
    (root / "shard_01" / "eval_results.json").write_text(json.dumps({"3": [ok(0)]}))
    assert not gates()["one part per unit the config resolves"] and not gates()["every attempt reconciles with a verdict"]
    build(spark, run)
    manifest = tmp / "corpus" / "manifest.json"
    m = json.loads(manifest.read_text())
    m["counts"]["rows"] += 1
    m["counts"]["cuts"] -= 1
    m["counts"]["truncated"] = 500
    manifest.write_text(json.dumps(m))
    (tmp / "corpus" / ".manifest.json.crc").unlink(missing_ok=True)
    now = gates()
    assert not any(now[k] for k in ("rows on disk match the manifest", "cuts on disk match the manifest", "truncated under 100"))


GOOD = "import torch\nimport torch.nn as nn\nimport triton\nimport triton.language as tl\n@triton.jit\ndef k(x, y, n, B: tl.constexpr):\n    i = tl.program_id(0) * B + tl.arange(0, B)\n    tl.store(y + i, tl.load(x + i, mask=i < n) * 2.0, mask=i < n)\nclass ModelNew(nn.Module):\n    def forward(self, x):\n        y = torch.zeros_like(x)\n        k[(1,)](x, y, x.numel(), B=64)\n        return y\n"


def test_scan_report_of_a_run(spark, tmp_path):
    """Kernels meet their verdicts and their problems' sources; a sample without a kernel or a verdict has no row."""
    root, ref = tmp_path / "m_level1", tmp_path / "problems"
    root.mkdir()
    ref.mkdir()
    (ref / "3_Relu.py").write_text("import torch\ndef get_inputs():\n    return [torch.rand(8)]\n")
    for (p, s), text in {(3, 0): GOOD, (3, 1): GOOD.replace("return y", "return torch.relu(y)"), (4, 0): "def (", (9, 9): GOOD}.items():
        (root / f"level_1_problem_{p}_sample_{s}_kernel.py").write_text(text)
    (root / "eval_results.json").write_text(json.dumps({"3": [ok(0), ok(1, 1.0), ok(5)], "4": [{"sample_id": 0, "compiled": False}]}))
    (tmp_path / "base.json").write_text(json.dumps({"level1": {"3_Relu.py": {"mean": 4.0}}}))
    scanned = scans.scan_run(spark, str(root), str(ref))
    rows = {(r["problem_id"], r["sample_id"]): r for r in scans.outcome_rows(spark, str(root), scanned, readers.baseline_times(spark, str(tmp_path / "base.json"))).collect()}
    assert set(rows) == {(3, 0), (3, 1), (4, 0)} and [rows[3, s]["speedup"] for s in (0, 1)] == [2.0, 4.0]
    assert rows[3, 0]["wasted_bytes"] == 32 and rows[3, 0]["F2_4"] and rows[3, 1]["F1_4"] and not rows[3, 1]["F2_4"] and rows[4, 0]["parse_status"] == "syntax_error" and rows[4, 0]["S1_0"]
    whole = {r["problem_id"]: r["source"] for r in runs.local_problems(spark, str(ref), 1).collect()}
    assert whole == {3: (ref / "3_Relu.py").read_text()} and {r["source"] for r in readers.kernel_files(spark, str(root)).where("problem_id = 9").collect()} == {GOOD}
    said = cli.main(["report", str(root), "--references", str(ref), "--baseline", str(tmp_path / "base.json")], spark)
    line = next(x for x in said.split("\n") if x.startswith("F1.4")).split()
    assert line[1:] == ["3", "0.3333", "1.0000", "0.5000", "4.0000", "2.0000"]


def test_corpus_commands(spark, run):
    root, tmp = run
    out = str(tmp / "c")
    built = json.loads(cli.main(["build", out, str(root), "--baseline", str(tmp / "base.json"), "--exclude", str(tmp / "out.json"), "--set", "cuts.max_length=300"], spark))
    assert built["attempts"] == 11 and built["units_built"] == 1
    assert "rows on disk match the manifest" in cli.main(["gates", out, str(root), "--set", "cuts.max_length=300"], spark)
