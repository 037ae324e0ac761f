"""Static checks case by case: severities, helpers, submodules, layouts, buffers, sizes."""

import ast

import pytest

from tallyloom.operators import hostflow as H
from tallyloom.operators import shapes as Z
from tallyloom.operators import staticcheck as S

HEAD = """import torch
import torch.nn as nn
import torch.nn.functional as F
import triton
import triton.language as tl
@triton.jit
def k(x, y, n, B: tl.constexpr):
    i = tl.program_id(0) * B + tl.arange(0, B)
    v = tl.load(x + i, mask=i < n)
    tl.store(y + i, v * 2, mask=i < n)
@triton.jit
def acc(x, y, n, B: tl.constexpr):
    i = tl.program_id(0) * B + tl.arange(0, B)
    tl.atomic_add(y + i, tl.load(x + i, mask=i < n) + 1, mask=i < n)
@triton.jit
def diag(x, y, n, B: tl.constexpr):
    i = tl.program_id(0) * B + tl.arange(0, B)
    tl.store(y + i * (n + 1), tl.load(x + i) * 3, mask=i < n)
"""


def module(body, init="", head=HEAD):
    lines = "\n".join("        " + x for x in body.strip("\n").split("\n"))
    made = "    def __init__(self):\n        super().__init__()\n" + "".join(f"        {x}\n" for x in init.split("\n") if x) if init else ""
    return f"{head}class ModelNew(nn.Module):\n{made}    def forward(self, x):\n{lines}\n"


def found(src, *ids):
    report = S.analyze(src)
    assert report["parse_status"] == "ok" and report["notes"] == []
    return sorted((f["check_id"], f["severity"]) for f in report["findings"] if not ids or f["check_id"] in ids)


RUN = "y = torch.empty_like(x)\nk[(1,)](x, y, x.numel(), B=64)\n"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (RUN + "return y", []),
        (RUN + "return torch.relu(y)", [("F1.4", "warn")]),
        (RUN + "return F.gelu(y)", [("F1.4", "warn")]),
        (RUN + "return F.some_new_op(y)", [("F1.4", "warn")]),
        (RUN + "return F._Reduction.get_enum(y)", []),
        (RUN + "return y.matmul(x)", [("F1.4", "fail")]),
        (RUN + "return torch.mv(x, y)", [("F1.4", "fail")]),
        (RUN + "return F.max_pool2d(torch.relu(y), 2)", [("F1.4", "fail")]),
        (RUN + "return F.unfold(y, 2)", [("F1.4", "fail")]),
        (RUN + "return y.unfold(0, 2, 1)", []),
        (RUN + "return y + 1", [("F1.4", "warn")]),
        (RUN + "return x @ y", [("F1.4", "fail")]),
        ("n = x.numel() // 4 + x.shape[0] * 2\n" + RUN + "return y", []),
        ("n = sum(d * d for d in (1, 2)) + round(2.5)\n" + RUN + "return y", []),
        (RUN + "return sum([x, y])", [("F1.4", "warn")]),
        ("m = tl.sum(3)\n" + RUN + "return y", []),
    ],
)
def test_fallback(body, want):
    assert found(module(body), "F1.4") == want


def test_own_helpers_are_no_fallback():
    helper = HEAD + "def softmax(a):\n    out = torch.empty_like(a)\n    k[(1,)](a, out, a.numel(), B=64)\n    return out\n"
    assert found(module("return softmax(x)", head=helper)) == [("F1.2", "fail")] * 2
    late = helper + "class Inner(nn.Module):\n    def forward(self, a):\n        return torch.matmul(a, a)\n"
    assert found(module("return softmax(self.inner(x))", "self.inner = Inner()", late), "F1.4") == [("F1.4", "fail")]
    grad = HEAD + "class Fn(torch.autograd.Function):\n    @staticmethod\n    def forward(ctx, a):\n        out = torch.empty_like(a)\n        k[(1,)](a, out, a.numel(), B=64)\n        return out\n    @staticmethod\n    def backward(ctx, g):\n        return torch.matmul(g, g)\n"
    assert found(module("return Fn.apply(x)", head=grad), "F1.3", "F1.4") == []


def test_modules():
    assert found(module(RUN + "return self.l(y)", "self.l = nn.Linear(2, 2)"), "F1.5") == [("F1.5", "fail")]
    assert found(module(RUN + "return self.l(y)", "self.l = nn.PixelShuffle(2)"), "F1.5") == [("F1.5", "warn")]
    assert found(module(RUN + "return self.l(y)", "self.l = nn.Dropout(0.1)"), "F1.5") == []
    assert found(module("y = torch.empty_like(x)\nk[(1,)](x, y, self.l.weight, B=64)\nreturn y", "self.l = nn.Linear(2, 2)"), "F1.5") == []
    own = HEAD + "class Mine(nn.Module):\n    def forward(self, a):\n        out = torch.empty_like(a)\n        k[(1,)](a, out, a.numel(), B=64)\n        return out\n"
    assert found(module("return self.s(x)", "self.s = nn.Sequential(Mine(), Mine())", own), "F1.5") == []
    assert found(module("return self.s(x)", "self.s = nn.Sequential(Mine(), nn.Linear(2, 2))", own), "F1.5") == [("F1.5", "fail")]


def test_discarded_and_zeroed_buffers():
    assert found(module(RUN + "return x"), "F1.3") == [("F1.3", "fail")]
    through = HEAD + "def run(a, out):\n    k[(1,)](a, out, a.numel(), B=64)\n"
    assert found(module("y = torch.empty_like(x)\nrun(x, y)\nreturn y", head=through), "F1.3") == []
    assert found(module("y = torch.empty_like(x)\nrun(x, y)\nreturn x", head=through), "F1.3") == [("F1.3", "fail")]
    assert found(module("y = torch.empty_like(x)\nz = y.view(-1)\nk[(1,)](x, z, 4, B=64)\nreturn y"), "F1.3") == []
    assert found(module("k[(1,)](x, x, 4, B=64)\nreturn x"), "F1.3") == []
    zeros = "y = torch.zeros_like(x)\n{}[(1,)](x, y, 4, B=64)\nreturn y"
    assert [found(module(zeros.format(name)), "F2.4") for name in ("k", "acc", "diag")] == [[("F2.4", "warn")], [], []]
    assert found(module("y = torch.zeros_like(x)\nk[(1,)](x, y, 4, B=64)\nreturn y.sum()"), "F2.4") == []


def test_layouts_and_casts():
    assert found(module(RUN + "return y.contiguous()"), "F2.3") == []
    assert found(module("z = x.permute(1, 0).contiguous()\n" + RUN + "return y"), "F2.3") == [("F2.3", "warn")]
    assert found(module("t = x.transpose(0, 1)\nz = t.contiguous()\n" + RUN + "return y"), "F2.3") == [("F2.3", "warn")]
    assert found(module("z = x.T.contiguous()\n" + RUN + "return y"), "F2.3") == [("F2.3", "warn")]
    assert found(module("z = x.to('cuda')\nw = x.float()\n" + RUN + "return y"), "F2.3") == []
    assert found(module("z = x.to(torch.float16)\nw = x.to(dtype=torch.half)\n" + RUN + "return y"), "F2.3") == [("F2.3", "warn")] * 2
    assert found(module("z = torch.cat([x, x])\n" + RUN + "return y"), "F2.3") == [("F2.3", "warn")]


def test_launches_and_intermediates():
    three = "a = torch.empty_like(x)\nb = torch.empty_like(x)\nc = torch.empty_like(x)\nk[(1,)](x, a, 4, B=64)\nk[(1,)](a, b, 4, B=64)\nk[(1,)](b, c, 4, B=64)\nreturn c"
    assert found(module(three), "F2.1", "F2.2") == [("F2.1", "warn"), ("F2.2", "info")]
    small = "\nN = 16\ndef get_inputs():\n    return [torch.rand(N, 2 * N)]\n"
    large = "\nN = 2 ** 14\ndef get_inputs():\n    return [torch.rand(N, N)]\n"
    assert found(module(three) + small, "F2.2") == [("F2.2", "warn")] and found(module(three) + large, "F2.2") == [("F2.2", "info")]
    assert found(module("y = torch.empty_like(x)\nfor t in range(4):\n    k[(1,)](x, y, 4, B=64)\nreturn y"), "F2.2") == [("F2.2", "fail")]


def test_kernels():
    slow = HEAD.replace("tl.arange(0, B)", "0").replace("    v = tl.load", "    for j in range(n):\n        pass\n    v = tl.load", 1)
    assert found(module(RUN + "return y", head=slow), "F3.1", "F3.2") == [("F3.1", "warn")]
    loops = HEAD.replace("    v = tl.load", "    for j in range(n):\n        pass\n    for j in range(B):\n        pass\n    v = tl.load", 1)
    assert found(module(RUN + "return y", head=loops), "F3.1", "F3.2") == [("F3.2", "info")]
    r = H.roles(next(n for n in ast.parse(HEAD).body if getattr(n, "name", "") == "acc"))
    assert r["x"].loaded and not r["x"].stored and r["y"].atomic and r["y"].stored and not r["n"].loaded


def test_input_shapes():
    src = "B, D = 4, 8\nn = 16\nm = n * 2 - 1\ndef get_inputs():\n    k = 3\n    a = torch.randn(n, m)\n    return [a, torch.rand((k, 5), dtype=torch.float16).cuda(), torch.randint(0, 9, (n,)), torch.full((2, 2), 1.0), torch.rand(n) * 2, torch.rand(u)]\n"
    got = Z.source_inputs(src)
    assert got == [((16, 31), "float32"), ((3, 5), "float16"), ((16,), "int64"), ((2, 2), "float32"), ((16,), "float32"), None] and Z.input_bytes(got) is None
    whole = "n = 16\ndef get_inputs():\n    return [torch.rand(n, 4), torch.rand(2)]\n"
    assert Z.input_bytes(Z.source_inputs(whole)) == 4 * (64 + 2) and Z.input_bytes(Z.source_inputs("x = 1")) is None and Z.source_inputs("def (") == []


def test_nothing_breaks_the_checks():
    src = module(RUN + "return y", "self.l = nn.Linear(2, 2)")
    for i in range(0, len(src), 7):
        assert S.analyze(src[:i])["notes"] == []


def test_outcomes_repeat_no_row_for_each_check(spark):
    """Exact medians without a group that holds all its values: no percentile and no row a check; ties, nulls, odd and even counts, a check that nothing meets."""
    rows = [(i % 3 == 0, False, None if i % 5 == 0 else i % 2 == 0, i % 2, None if i % 7 == 0 else (i * 37 % 101) / 8 if i % 4 else 2.5) for i in range(400)]
    d = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, y int, v double")
    out = S.outcomes(d, ["a", "b", "c"], "y", "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "percentile" not in plan.lower() and "median(" not in plan
    got = {r["check_id"]: r for r in out.collect()}
    mean = lambda xs: round(sum(xs) / len(xs), 4) if xs else None
    for k, name in enumerate("abc"):
        r, known = got[name], [x for x in rows if x[k] is not None]
        assert r["n"] == 400 and r["rate"] == pytest.approx(mean([x[k] for x in known]))
        for flag, share, speed in ((True, "correct_flagged", "speedup_flagged"), (False, "correct_clean", "speedup_clean")):
            mine = [x for x in known if x[k] is flag]
            vs = sorted(x[4] for x in mine if x[4] is not None)
            assert r[share] == (pytest.approx(mean([x[3] for x in mine])) if mine else None)
            assert r[speed] == (pytest.approx(round((vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2, 4)) if vs else None)
