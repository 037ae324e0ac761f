"""Readers over small run folders, texts, static checks, joint calibration and incremental files."""

import json

import pytest

from tallyloom.functions import texts as X
from tallyloom.operators import calibration as C
from tallyloom.operators import staticcheck as S
from tallyloom.operators.ranking import diversify
from tallyloom.sources import readers
from tallyloom.streaming.incremental import process_new_files


def test_readers(spark, tmp_path):
    unit = tmp_path / "run1" / "shard_00"
    unit.mkdir(parents=True)
    (unit / "attempts.jsonl").write_text(json.dumps({"stem": "a", "level": 1, "problem_id": 3, "sample_id": 0, "raw": "x", "trace": {"passes": 1, "code_finish_reason": "stop"}}) + "\n")
    verdict = {"3": [{"sample_id": 0, "compiled": True, "correctness": True, "runtime": 2.0}, {"sample_id": 1, "compiled": False}]}
    (unit / "eval_results.json").write_text(json.dumps(verdict))
    a = readers.attempts(spark, str(unit / "attempts.jsonl"))
    v = readers.verdicts(spark, str(unit / "eval_results.json"))
    joined = a.join(v, ["run_name", "shard", "problem_id", "sample_id"], "left").collect()
    assert [(r["run_name"], r["shard"], r["runtime"], r["correctness"]) for r in joined] == [("run1", "shard_00", 2.0, True)] and v.count() == 2
    (unit / "twice.json").write_text(json.dumps({"3": [{"sample_id": 0}, {"sample_id": 0}]}))
    with pytest.raises(ValueError, match="duplicate verdict"):
        readers.verdicts(spark, str(unit / "twice.json"))
    (tmp_path / "base.json").write_text(json.dumps({"level2": {"7_Name.py": {"mean": 1.5}, "bad": {"mean": 1.0}}, "other": {}}))
    assert [tuple(r) for r in readers.baseline_times(spark, str(tmp_path / "base.json")).collect()] == [(2, 7, "7_Name.py", 1.5, None)]
    (tmp_path / "out.json").write_text(json.dumps({"_meta": "x", "level1": [4, 5]}))
    assert sorted(map(tuple, readers.exclusions(spark, str(tmp_path / "out.json")).collect())) == [(1, 4), (1, 5)]
    (tmp_path / "level_1_problem_2_sample_3_kernel.py").write_text("x = 1\n")
    assert [tuple(r)[:3] for r in readers.kernel_files(spark, str(tmp_path)).collect()] == [(1, 2, 3)]


def test_incremental_files(spark, tmp_path):
    src, args = tmp_path / "in", (str(tmp_path / "in"), "a long", str(tmp_path / "ck"), str(tmp_path / "out"))
    src.mkdir()
    (src / "1.json").write_text('{"a": 1}\n')
    process_new_files(spark, *args, lambda d: d.selectExpr("a * 10 AS b"))
    (src / "2.json").write_text('{"a": 2}\n')
    process_new_files(spark, *args, lambda d: d.selectExpr("a * 10 AS b"))
    assert sorted(r["b"] for r in spark.read.parquet(args[3]).collect()) == [10, 20]


def test_texts():
    assert X.parse_int_spec("1-3,7,2") == [1, 2, 3, 7, 2]
    t = "Plan\n```python\nimport torch\nclass ModelNew:\n    pass\n```\nafter ``` x"
    (a, b), = X.fence_spans(t)
    assert t[a:b] == "import torch\nclass ModelNew:\n    pass\n" and not X.unterminated(t) and X.unterminated("```py\nx")
    assert X.extract_code(t) == "import torch\nclass ModelNew:\n    pass"
    cuts = X.cut_points(t)
    assert [(t[:p].split("\n")[-2], k) for p, k, _ in cuts] == [("Plan", "prose"), ("```python", "prose"), ("import torch", "code"), ("class ModelNew:", "code"), ("    pass", "code"), ("```", "prose")]
    assert X.cut_points("```py\nx = (\n") is None and X.live_cuts("a\n```py\ny = 1\nx = (\n") == [(2, "prose", 0), (8, "prose", 1), (14, "code", 2)]
    for p in (t[:i] for i in range(len(t))):
        X.extract_code(p), X.live_cuts(p)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("use ```tl.minimum(x) here\n", []),
        ("a\n```\nb\n```\n", []),
        ("```c#  \r\nx\n```", [(9, 11)]),
        ("```py\na\n```py\nb\n```\n", [(6, 8), (14, 16)]),
        ("x```python\ny", [(11, 12)]),
        ("```py", [(5, 5)]),
        ("", []),
        (None, []),
    ],
)
def test_fence_spans(spark, text, spans):
    assert X.fence_spans(text) == spans
    got = X.fence_table(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").orderBy("block").collect()
    assert [(r["a"], r["b"]) for r in got] == spans


ENTRY = "class ModelNew:\n    def forward(self):\n        return 1"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("Here:\nimport os\nx = (1,\n", "Here:\nimport os\nx = (1,"),
        ("I cannot do this.", "I cannot do this."),
        (f"```python\nx=1\n```\nThe answer:\n{ENTRY}\n", ENTRY),
        (f"```python\n{ENTRY}\n```\nthen\n```python\ny = 2\n```\n", ENTRY),
        (f"```py\n{ENTRY}\n```\n```py\n{ENTRY}  # two\n```\n", f"{ENTRY}  # two"),
        ("```py\ndef f(a, a): pass\n```\n```py\nx =\n```\n", "def f(a, a): pass"),
        ("```py\nx =\n```\n```py\ny =\n```\n", "x ="),
        (f"## Plan\n\n  import os\n  {ENTRY.replace(chr(10), chr(10) + '  ')}\n  and so on it goes (\n", f"import os\n{ENTRY}"),
        (f"```python\n{ENTRY}\n```</answer>", ENTRY),
        ("return f(x)```python\n", "return f(x)"),
        ("class ModelNewHelper:\n  pass", "class ModelNewHelper:\n  pass"),
        (None, ""),
    ],
)
def test_extract_code(text, code):
    assert X.extract_code(text) == code


def test_cut_points_split_at_newlines_only():
    assert X.cut_points("abc\f\nd\n") == [(5, "prose", 0), (7, "prose", 1)]
    t = "p\u2028q\n```py\nx = 'a\u2028b'\n\nif x:\n    y = (1,\n  2)\n# note\nz = 1```\n"
    cuts = X.cut_points(t)
    assert [p for p, *_ in cuts] == sorted(p for p, *_ in cuts) and all(t[p - 1] == "\n" for p, *_ in cuts)
    assert [t[:p].split("\n")[-2] for p, k, _ in cuts if k == "code"] == ["x = 'a\u2028b'", "if x:", "  2)"]
    assert [i for *_, i in X.cut_points(t, 1, 2)] == [0, 1, 2, 3] and sum(k == "code" for _, k, _ in X.cut_points(t, 1, 2)) == 1
    with pytest.raises(ValueError, match="every 1 or more"):
        X.cut_points(t, 0, 1)


def test_static_checks():
    good = "import torch\nimport triton\nimport triton.language as tl\n@triton.jit\ndef k(x, y, n, B: tl.constexpr):\n    i = tl.program_id(0) * B + tl.arange(0, B)\n    v = tl.load(x + i, mask=i < n)\n    tl.store(y + i, v * 2, mask=i < n)\nclass ModelNew(torch.nn.Module):\n    def forward(self, x):\n        y = torch.empty_like(x)\n        k[(1,)](x, y, x.numel(), B=64)\n        return y\n"
    ids = lambda s: {f["check_id"] for f in S.analyze(s)["findings"]}
    assert ids(good) == set()
    assert ids(good.replace("v * 2", "v")) == {"F1.6"}
    assert "F1.2" in ids(good.replace("        k[(1,)](x, y, x.numel(), B=64)\n", ""))
    assert ids(good.replace("return y", "return torch.softmax(y, 0)")) == {"F1.4"}
    assert ids(good.replace("import torch\n", "", 1)) == {"S1.3"}
    assert ids("def f(:") == {"S1.0"} and ids("") == {"S1.1"} and S.analyze(None)["parse_status"] == "empty"
    assert S.submission_ok(good) and not S.submission_ok("x = 1")


def test_curves(spark):
    assert C.pool_adjacent([0, 0.9, 0.1, 1]) == [0, 0.5, 0.5, 1]
    c = C.Curve([0.0, 10.0], [0.0, 1.0], [0.0, 0.0], [1, 1])
    assert [c(-1), c(5), c(11)] == [0.0, 0.5, 1.0]
    rows = [(1, p, float(s), min(1.0, max(0.0, s / 10 + (p % 3 - 1) * 0.1))) for p in range(12) for s in range(10)]
    curve, offsets = C.fit_joint(spark.createDataFrame(rows, "level long, problem_id long, score double, target double"), rounds=3, n_bands=5)
    assert curve.y == sorted(curve.y) and offsets.count() == 12
    mean = {k: 0.0 for k in range(3)}
    for r in offsets.collect():
        mean[r["problem_id"] % 3] += r["c"]
    assert mean[0] <= mean[1] <= mean[2]


def test_diversify():
    assert diversify([("a", "p", 3.0), ("b", "p", 2.0)], [("c", "q", 1.0)], 2) == ["a", "c"]
    assert diversify([("a", "p", 3.0)], [("c", "q", 1.0)], 2) == ["a"]
