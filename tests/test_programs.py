"""Call graphs, kernel data flow, chains of buffers and sizes: what each rule tells apart, and the table-wide closures."""

import ast

import pytest

from tallyloom.operators import callgraph as G
from tallyloom.operators import shapes as Z
from tallyloom.operators import staticcheck as S
from tallyloom.operators.kernelflow import KernelFlow
from tallyloom.plans import programs as P

IMPORTS = "import torch\nimport torch.nn as nn\nimport triton\nimport triton.language as tl\n"
WORK = "@triton.jit\ndef work(x, y, n, B: tl.constexpr):\n    i = tl.program_id(0) * B + tl.arange(0, B)\n    tl.store(y + i, tl.load(x + i, mask=i < n) * 2.0, mask=i < n)\n"
GO = "    y = torch.empty_like(x)\n    work[(1,)](x, y, x.numel(), B=64)\n    return y\n"


def indent(text, by=1):
    return "".join("    " * by + line + "\n" for line in text.rstrip("\n").split("\n"))


def entry(forward, init=""):
    made = f"    def __init__(self{', ' + init.split('|')[0] if '|' in init else ''}):\n        super().__init__()\n        {init.split('|')[-1]}\n" if init else ""
    return f"class ModelNew(nn.Module):\n{made}    def forward(self, x):\n        {forward}\n"


#: (rest of the program, severity of work being dead or None, launches of it in the timed path)
GRAPHS = {
    "direct": ("class ModelNew(nn.Module):\n    def forward(self, x):\n" + indent(GO), None, 1),
    "helper": ("def go(x):\n" + GO + entry("return go(x)"), None, 1),
    "callback": ("def go(x):\n" + GO + "def apply(f, x):\n    return f(x)\n" + entry("return apply(go, x)"), None, 1),
    "method": ("class Base(nn.Module):\n    def go(self, x):\n" + indent(GO) + "class ModelNew(Base):\n    def forward(self, x):\n        return self.go(x)\n", None, 1),
    "submodule": ("class Part(nn.Module):\n    def forward(self, x):\n" + indent(GO) + entry("return self.part(x)", "self.part = Part()"), None, 1),
    "in a container": ("class Part(nn.Module):\n    def forward(self, x):\n" + indent(GO) + entry("return self.parts(x)", "self.parts = nn.Sequential(Part(), Part())"), None, 1),
    "default class": ("class Part(nn.Module):\n    def forward(self, x):\n" + indent(GO) + entry("return self.part(x)", "kind=Part|self.part = kind()"), None, 1),
    "autograd": ("class Fn(torch.autograd.Function):\n    @staticmethod\n    def forward(ctx, x):\n" + indent(GO) + entry("return Fn.apply(x)"), None, 1),
    "backward only": ("class Fn(torch.autograd.Function):\n    @staticmethod\n    def forward(ctx, x):\n        return x\n    @staticmethod\n    def backward(ctx, x):\n" + indent(GO) + entry("return Fn.apply(x)"), None, 0),
    "another method": ("class ModelNew(nn.Module):\n    def forward(self, x):\n        return x\n    def predict(self, x):\n" + indent(GO), "fail", 0),
    "unused helper": ("def go(x):\n" + GO + entry("return x"), "fail", 0),
    "recursive": ("def go(x, n):\n    if n:\n        return go(x, n - 1)\n" + GO + entry("return go(x, 3)"), None, 1),
    "no class": ("", "fail", 0),
    "no forward": ("class ModelNew(nn.Module):\n    def run(self, x):\n" + indent(GO), "info", 0),
    "by another name": ("class Net(nn.Module):\n    def forward(self, x):\n" + indent(GO) + "class Other(nn.Module):\n    pass\nModelNew = Net\n", None, 1),
    "class attribute of the wrong class": ("class Part(nn.Module):\n    def forward(self, x):\n" + indent(GO) + entry("return self.other(x)", "part = Part()"), "fail", 0),
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_dead_kernels(name):
    rest, dead, _ = GRAPHS[name]
    found = [f["severity"] for f in S.analyze(IMPORTS + WORK + rest)["findings"] if f["check_id"] == "F1.2"]
    assert found == ([dead] if dead else [])


def test_closures_of_a_table(spark):
    """All programs closed together agree with each by itself; cycles end; a program without text has no rows."""
    rows = [(n, IMPORTS + WORK + rest) for n, (rest, _, _) in GRAPHS.items()] + [("broken", "def ("), ("none", None), ("empty", "")]
    g = S.graphs(spark.createDataFrame(rows, "name string, source string"), "name").cache()
    uses = {r["name"]: (r["dead"], r["timed"], r["live"]) for r in G.kernel_uses(g, "name").collect()}
    assert uses == {n: (dead, timed, dead is None) for n, (_, dead, timed) in GRAPHS.items()}
    met = G.closures(g, "name").collect()
    for n, text in rows:
        p = S.Program(text or "")
        for does in (False, True):
            want = set(G.closure(G.program_edges(p), G.entry_of(p), does))
            assert {r["node"] for r in met if r["name"] == n and (r["does"] or not does)} == want


def test_device_functions_live_with_their_callers():
    dev, call = "@triton.jit\ndef half(a):\n    return a * 0.5\n", WORK.replace("mask=i < n) * 2.0", "mask=i < n) * half(2.0)")
    body = GRAPHS["direct"][0]
    dead = lambda src: [f["message"] for f in S.analyze(IMPORTS + src)["findings"] if f["check_id"] == "F1.2"]
    assert dead(dev + call + body) == [] and "half" in dead(dev + WORK + body)[0] and len(dead(dev + call + entry("return x"))) == 2


#: Bodies of a kernel (x, y, z, n, s, B) and their kind.
KINDS = [
    ("v = tl.load(x + i, mask=i < n)\ntl.store(y + i, v, mask=i < n)", "copy"),
    ("tl.store(y + i, tl.load(x + i))", "copy"),
    ("src = x + i\ndst = y + i\nv = tl.load(src).to(tl.float32)\nw = tl.reshape(v, (B,))\ntl.store(dst, w)", "copy"),
    ("j = n - 1 - i\nv = tl.load(x + j)\ntl.store(y + i, v)", "elementwise"),
    ("src = x + (n - 1 - i)\nv = tl.load(src)\ntl.store(y + i, v)", "elementwise"),
    ("v = tl.load(x + i)\ntl.store(y + s + i, v)", "elementwise"),
    ("v = tl.load(x + s + i)\ntl.store(y + i, v)", "elementwise"),
    ("j = tl.load(z + i)\nv = tl.load(x + j)\ntl.store(y + i, v)", "elementwise"),
    ("src = tl.where(i < n, x + i, z + i)\ntl.store(y + i, tl.load(src))", "elementwise"),
    ("v = tl.load(x + i)\nif s == 0:\n    w = v * 2.0\nelse:\n    w = v\ntl.store(y + i, w)", "elementwise"),
    ("v = tl.load(x + i)\ntl.store(y + i, -v)", "elementwise"),
    ("v = tl.load(x + i)\ntl.store(y + i, tl.exp(v))", "elementwise"),
    ("v = tl.load(x + i)\nv += 1.0\ntl.store(y + i, v)", "elementwise"),
    ("tl.store(y + i, i * 2.0)", "elementwise"),
    ("a = 0.0\nfor j in range(n):\n    a += tl.load(x + j)\ntl.store(y + i, a)", "reduction"),
    ("a = 0.0\nj = 0\nwhile j < n:\n    a = a + tl.load(x + j)\n    j += 1\ntl.store(y + i, a)", "reduction"),
    ("p = x + i\nfor j in range(n):\n    v = tl.load(p)\n    tl.store(y + i + j, v * 2.0)\n    p += B", "elementwise"),
    ("tl.store(y, tl.sum(tl.load(x + i), axis=0))", "reduction"),
    ("a = tl.load(x + i)\ntl.store(y + i, tl.dot(a, a))", "matmul"),
    ("v = tl.load(x + i)", "unknown"),
]


def kernel(body):
    src = "def k(x, y, z, n, s, B):\n    i = tl.program_id(0) * B + tl.arange(0, B)\n" + indent(body)
    return KernelFlow(ast.parse(src).body[0])


@pytest.mark.parametrize(("body", "kind"), KINDS)
def test_kinds(body, kind):
    assert kernel(body).kind == kind


@pytest.mark.parametrize(
    ("body", "whole"),
    [
        ("tl.store(y + i, 0.0, mask=i < n)", True),
        ("r = tl.arange(0, B)\nc = tl.arange(0, 8)\ntl.store(y + r[:, None] * s + c[None, :], 0.0, mask=(r[:, None] < n) & (c[None, :] < s))", True),
        ("r = tl.arange(0, B)\nc = tl.arange(0, 8)\ntl.store(y + r[:, None] * s + c[None, :], 0.0, mask=r[:, None] >= c[None, :])", False),
        ("tl.store(y + i * 2, 0.0)", False),
        ("tl.store(y + (i // 4) * s + i % 4, 0.0)", False),
        ("j = tl.program_id(1)\ntl.store(y + j * n + j * s, 0.0)", False),
    ],
)
def test_stores_that_cover(body, whole):
    k = kernel(body)
    assert k.covers(k.stores[0][0]) == whole


def launches(body, inputs="", head=WORK):
    return IMPORTS + head + "class ModelNew(nn.Module):\n    def forward(self, x):\n" + indent(body, 2) + inputs


def chain(n, start="x", name="t"):
    lines = []
    for i in range(n):
        lines += [f"{name}{i} = torch.empty_like({start})", f"work[(1,)]({start}, {name}{i}, 4, B=64)"]
        start = f"{name}{i}"
    return "\n".join(lines)


def test_chains_are_one_finding_each():
    f21 = lambda src, ref=None: [(f["severity"], f["bytes"], f["message"].partition(":")[0]) for f in S.analyze(src, ref)["findings"] if f["check_id"] == "F2.1"]
    assert f21(launches(chain(4) + "\nreturn t3")) == [("warn", None, "t0, t1, t2")]
    assert f21(launches(chain(3) + "\n" + chain(3, "x", "u") + "\nreturn t2, u2")) == [("warn", None, "t0, t1"), ("warn", None, "u0, u1")]
    assert f21(launches(chain(3) + "\nreturn t2, t0")) == [("warn", None, "t1")]
    fold = WORK.replace("tl.load(x + i, mask=i < n) * 2.0", "tl.sum(tl.load(x + i, mask=i < n), axis=0)")
    assert f21(launches(chain(2) + "\nreturn t1", head=fold)) == [("info", None, "t0")]
    sized = "def get_inputs():\n    return [torch.rand(8, 4, dtype=torch.float16)]\n"
    assert f21(launches(chain(3) + "\nreturn t2", sized)) == [("warn", 2 * 2 * 64, "t0, t1")]
    assert f21(launches(chain(3) + "\nreturn t2"), sized) == [("warn", 2 * 2 * 64, "t0, t1")]
    one = "def step(a):\n    out = torch.empty_like(a)\n    work[(1,)](a, out, 4, B=64)\n    return out\n"
    assert f21(launches("p = step(x)\nreturn step(p)", head=WORK + one)) == []  # one call site in the text, as often as it runs
    two = one + one.replace("step", "more")
    assert f21(launches("p = step(x)\nreturn more(p)", sized, WORK + two)) == [("warn", 128, "p")]


@pytest.mark.parametrize(
    ("body", "name", "want"),
    [
        ("b, c = x.shape\ny = torch.empty((c, b * 2))", "y", ((6, 8), "float32")),
        ("n = x.numel() // 2\ny = torch.empty(n)", "y", ((12,), "float32")),
        ("y = torch.zeros(x.size(1), x.shape[0], dtype=torch.int64)", "y", ((6, 4), "int64")),
        ("y = torch.empty(x.shape[7])", "y", None),
        ("y = torch.empty_like(x, dtype=torch.float64)\nz = torch.ones_like(y)", "z", ((4, 6), "float64")),
        ("y = torch.empty(x.shape)", "y", ((4, 6), "float32")),
        ("y = torch.empty_like(other)", "y", None),
        ("y = helper(x)", "y", ((4, 6), "float32")),
    ],
)
def test_sizes(body, name, want):
    helper = "def helper(a):\n    out = torch.empty_like(a)\n    work[(1,)](a, out, 4, B=64)\n    return out\n"
    src = launches(body + f"\nwork[(1,)](x, {name}, 4, B=64)\nreturn {name}", head=WORK + helper)
    for text, ref in ((src + "def get_inputs():\n    return [torch.rand(4, 6)]\n", "def get_inputs():\n    return [torch.rand(1)]\n"), (src, "def get_inputs():\n    return [torch.rand(4, 6)]\n")):
        p = S.Program(text, ref)
        assert p.sizes.tensors.get(p.flow.find(p.flow.scopes[0], name)) == want
    assert Z.tensor_bytes(((2, 3), "int64")) == 48


def test_scan_joins_references(spark):
    """Sizes come from the problem's source where the program has none; each text and reference is analyzed once, and no row is lost."""
    src = launches(chain(3) + "\nreturn t2")
    d = spark.createDataFrame([(1, src), (1, src), (2, src), (3, None), (None, src)], "problem int, source string")
    ref = spark.createDataFrame([(1, "def get_inputs():\n    return [torch.rand(8)]\n"), (3, "def (")], "problem int, reference string")
    got = sorted(((r["problem"], r["report"]["parse_status"], r["report"]["wasted_bytes"], r["report"]["n_launches"]) for r in S.scan(d, references=ref, by=["problem"]).collect()), key=repr)
    assert got == [(1, "ok", 128, 3)] * 2 + [(2, "ok", 0, 3), (3, "empty", 0, 0), (None, "ok", 0, 3)]
    assert S.scan(d.limit(0)).count() == 0
    assert {f["check_id"] for f in S.analyze("x = 1", only="S1")["findings"]} == {"S1.1"}


def test_programs_cover_the_checks(spark, sf):
    """The generated programs meet every check, and clean ones too."""
    found = P.lint_findings(spark, sf).collect()
    assert {r["check_id"] for r in found} == set(S.CHECKS) - {"F1.1"}
    parts = {r["part"] for r in P.programs(spark, sf).collect()}
    assert 0 < len(parts - {r["part"] for r in found}) < len(parts)


def test_a_code_is_analyzed_once(spark):
    """Texts that differ only in a last comment of plain words are one code, dealt over tasks; reports, lines and uses are those of each text alone."""
    tails = ["# part 1\n", "# part 22", "# part 1\n# x\n", "", "# it's\n", "\\\n# part 3\n", "x = '''\n# part 4\n", "x = '''\n# part '''\n", "if x:\n# part 5\n", "def (\n# part 6\n", "def (\n# part 77\n"]
    head = "import triton\n@triton.jit\ndef k(x):\n    pass\nclass ModelNew:\n    def forward(self):\n        k[(1,)](self)\n"
    d = spark.createDataFrame([(i, head + t) for i, t in enumerate(tails)], "part int, source string")
    d = d.unionByName(d.limit(0)).cache()
    _, codes = S._codes(d, "source")
    assert codes.count() == len(tails) - 1  # the last two are one
    assert "RepartitionByExpression" in codes._jdf.queryExecution().logical().toString()
    for r in S.scan(d).collect():
        want = S.analyze(r["source"])
        got = r["report"].asDict(recursive=True)
        assert got == want, r["source"]
    uses = {(r["part"], r["kernel"]): r["dead"] for r in S.kernel_uses(d, "part").collect()}
    assert uses == {(i, k): None for i, t in enumerate(tails) for k in S.graph_of(head + t)["kernels"]}


def test_programs_are_spread_over_tasks(spark, tmp_path):
    """A small file's parts are not one task's."""
    spark.createDataFrame([(i, i % 50) for i in range(60)], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert P.programs(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
