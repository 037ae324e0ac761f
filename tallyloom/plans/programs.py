"""Programs made of the part table, a text for each part, and queries of the static checks over all of them.

Which fault a program has follows from its part's key and size, so that each check's findings have a closed form,
which the DuckDB counterparts state without seeing a program's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staticcheck as S
from ..sources.adapters import candidates, table
from .queries import WITH, query

_HEAD = "import torch\nimport torch.nn as nn\nimport triton\n"
_DEVICE = "@triton.jit\ndef dev(a):\n    return a * 0.5\n"
_KERNEL = "@triton.jit\ndef k(x, y, n, B: tl.constexpr):\n"
_WIDE = "    i = tl.program_id(0) * B + tl.arange(0, B)\n"
_ONE = "    v = tl.load(x + tl.program_id(0))\n    tl.store(y + tl.program_id(0), v * 2.0)\n"
_LAUNCH = "k[(4,)](x, {}, x.numel(), B=64)\n"


def _pick(by: Column, *texts: str) -> Column:
    """The text at place ``by``; the last one beyond."""
    out = F.lit(texts[-1])
    for i in range(len(texts) - 2, -1, -1):
        out = F.when(by == i, F.lit(texts[i])).otherwise(out)
    return out


def _body(*lines: str) -> str:
    return "".join(f"        {x}\n" for x in lines)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, size, source). By the key: a fault of the file (% 12), the kernel's body (% 7), a second kernel (% 5), inputs (% 3), the way to the launch (// 7 % 4, where size % 11 = 0); by the size: what the host does (% 11)."""
    key, host = F.col("p_partkey"), F.col("p_size") % 11
    fault, body, second, inputs = key % 12, key % 7, key % 5, key % 3
    way = F.when(host == 0, F.floor(key / 7) % 4).otherwise(0)
    called = (second == 0) & (body <= 2)
    head = F.concat(F.lit(_HEAD), F.when(fault == 3, "").otherwise("import triton.language as tl\n"))
    device = F.when(called | (second == 1), _DEVICE).otherwise("")
    stored = F.when(called, "dev(v)").otherwise("v * 2.0")
    computed = F.concat(F.lit(_WIDE + "    v = tl.load(x + i, mask=i < n)\n    tl.store(y + i, "), stored, F.lit(", mask=i < n)\n"))
    copied = _WIDE + "    p = x + i\n    v = tl.load(p, mask=i < n).to(tl.float32)\n    w = v\n    tl.store(y + i, w, mask=i < n)\n"
    summed = _WIDE + "    v = tl.load(x + i, mask=i < n)\n    for j in range(n):\n        v = v + 1.0\n    tl.store(y + i, v, mask=i < n)\n"
    turned = _WIDE + "    v = tl.load(x + (n - 1 - i), mask=i < n)\n    tl.store(y + i, v, mask=i < n)\n"
    kernel = F.concat(F.lit(_KERNEL), F.when(body <= 2, computed).otherwise(_pick(body - 3, copied, _ONE, summed, turned)))
    step = "out = torch.empty_like(x)\n        " + _LAUNCH.format("out").strip()
    helper = "def go(x, out):\n    " + _LAUNCH.format("out")
    grad = "class Fn(torch.autograd.Function):\n    @staticmethod\n    def forward(ctx, x):\n{}    @staticmethod\n    def backward(ctx, x):\n{}"
    run = _body(step, "return out")
    before = F.when(host == 9, "fast = torch.compile(abs)\n").otherwise(_pick(way, "", helper, grad.format(run, _body("return x")), grad.format(_body("return x"), run)))
    made = F.when(host == 6, "    def __init__(self):\n        super().__init__()\n        self.lin = nn.Linear(16, 16)\n").otherwise("")
    plain = _pick(way, run, _body("out = torch.empty_like(x)", "go(x, out)", "return out"), _body("return Fn.apply(x)"))
    hosts = (
        _body(step, "return torch.relu(out)"),
        _body(step, "return torch.matmul(out, x)"),
        _body(step, "return x"),
        _body("return x"),
        _body("out = torch.empty_like(x)", "for j in range(4):", "    " + _LAUNCH.format("out").strip(), "return out"),
        _body(step, "return self.lin(out)"),
        _body(step.replace("empty_like", "zeros_like"), "return out"),
        _body("s = torch.empty_like(x)", _LAUNCH.format("s").strip(), "t = torch.empty_like(s)", _LAUNCH.format("t").strip().replace("(x,", "(s,"), "out = torch.empty_like(x)", _LAUNCH.format("out").strip().replace("(x,", "(t,"), "return out"),
        run,
        _body("z = x.t().contiguous()", step, "return out"),
    )
    forward = F.when(host == 0, plain).otherwise(_pick(host - 1, *hosts))
    cls = F.concat(F.lit("class "), F.when(fault == 1, "Net").otherwise("ModelNew"), F.lit("(nn.Module):\n"), made, F.lit("    def "), F.when(fault == 2, "run").otherwise("forward"), F.lit("(self, x):\n"), forward)
    given = _pick(inputs, "", "def get_inputs():\n    return [torch.rand(16, 16)]\n", "N = 2 ** 12\ndef get_inputs():\n    return [torch.rand(N, N)]\n")
    text = F.concat(head, device, kernel, before, cls, given, F.when(fault == 0, "def (\n").otherwise(""), F.lit("# part "), key.cast("string"), F.lit("\n"))
    # by number: the parts of a small file would all be one task's
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(key.alias("part"), F.col("p_size").alias("size"), text.alias("source"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(size, reference): the problems that programs of even sizes answer."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("size")).where("p_size % 2 = 0").distinct()
    return sizes.withColumn("reference", F.lit("import torch\ndef get_inputs():\n    return [torch.rand(16, 16)]\n"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan(programs(spark, sf_dir), references=references(spark, sf_dir), by=["size"])


#: What follows from a part's key and size, and the findings.
PROGRAMS_SQL = """
pg AS (
  SELECT p_partkey AS part, p_size AS size, p_partkey % 12 AS fault, p_partkey % 7 AS body, p_partkey % 5 AS second, p_size % 11 AS host,
    CASE WHEN p_size % 11 = 0 THEN p_partkey // 7 % 4 ELSE 0 END AS way,
    CASE p_partkey % 3 WHEN 1 THEN 1024::BIGINT WHEN 2 THEN 67108864::BIGINT ELSE CASE WHEN p_size % 2 = 0 THEN 1024::BIGINT END END AS nb FROM part),
pf AS (SELECT *, fault NOT IN (0, 2) AS runs, fault NOT IN (0, 2) AND host <> 4 AS launched, second = 0 AND body <= 2 AS called, CASE WHEN fault = 2 THEN 'info' ELSE 'fail' END AS deadly FROM pg),
found(part, check_id, severity, bytes) AS (
  SELECT part, 'S1.' || fault, 'fail', NULL::BIGINT FROM pf WHERE fault <= 3
  UNION ALL SELECT part, 'F1.2', deadly, NULL FROM pf WHERE fault <> 0 AND NOT launched
  UNION ALL SELECT part, 'F1.2', deadly, NULL FROM pf WHERE fault <> 0 AND (second = 1 OR called AND NOT launched)
  UNION ALL SELECT part, 'F1.3', 'fail', NULL FROM pf WHERE runs AND host = 3
  UNION ALL SELECT part, 'F1.4', CASE host WHEN 1 THEN 'warn' ELSE 'fail' END, NULL FROM pf WHERE runs AND host IN (1, 2)
  UNION ALL SELECT part, 'F1.5', 'fail', NULL FROM pf WHERE runs AND host = 6
  UNION ALL SELECT part, 'F1.6', 'fail', NULL FROM pf WHERE launched AND body = 3
  UNION ALL SELECT part, 'F1.7', 'fail', NULL FROM pf WHERE fault <> 0 AND host = 9
  UNION ALL SELECT part, 'F2.1', CASE WHEN body IN (3, 5) THEN 'info' ELSE 'warn' END, 4 * nb FROM pf WHERE runs AND host = 8
  UNION ALL SELECT part, 'F2.2', CASE WHEN host = 5 THEN 'fail' WHEN nb = 1024 THEN 'warn' ELSE 'info' END, NULL FROM pf WHERE runs AND host IN (5, 8)
  UNION ALL SELECT part, 'F2.3', 'warn', 2 * nb FROM pf WHERE runs AND host = 10
  UNION ALL SELECT part, 'F2.4', 'warn', nb FROM pf WHERE runs AND host = 7
  UNION ALL SELECT part, 'F3.1', 'info', NULL FROM pf WHERE launched AND body = 4
  UNION ALL SELECT part, 'F3.2', 'info', NULL FROM pf WHERE launched AND body = 5)"""


@query(f"WITH {PROGRAMS_SQL} SELECT part, check_id, severity, bytes FROM found")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every check over the programs of all parts."""
    return S.findings(scanned(spark, sf_dir), "part").select("part", "check_id", "severity", "bytes")


@query(f"""WITH {PROGRAMS_SQL}, g AS (SELECT part, count(*) FILTER (severity = 'fail') AS n_fail, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info, sum(bytes) FILTER (check_id IN ('F2.1', 'F2.3', 'F2.4')) AS wasted FROM found GROUP BY part)
SELECT CASE WHEN fault = 0 THEN 'syntax_error' ELSE 'ok' END AS parse_status, count(*) AS programs, coalesce(sum(n_fail), 0)::BIGINT AS n_fail, coalesce(sum(n_warn), 0)::BIGINT AS n_warn, coalesce(sum(n_info), 0)::BIGINT AS n_info,
  sum(CASE WHEN fault = 0 THEN 0 ELSE 1 + (called OR second = 1)::INT END)::BIGINT AS kernels, sum(CASE WHEN launched THEN CASE WHEN host = 8 THEN 3 ELSE 1 END ELSE 0 END)::BIGINT AS launches, coalesce(sum(wasted), 0)::BIGINT AS wasted_bytes
FROM pf LEFT JOIN g USING (part) GROUP BY ALL""")
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the reports, by parse status."""
    r = scanned(spark, sf_dir).select("report.*")
    return r.groupBy("parse_status").agg(F.count(F.lit(1)).alias("programs"), *(F.sum(c).alias(c) for c in ("n_fail", "n_warn", "n_info")), F.sum("n_kernels").alias("kernels"), F.sum("n_launches").alias("launches"), F.sum("wasted_bytes").alias("wasted_bytes"))


@query(f"""WITH {PROGRAMS_SQL}, u AS (SELECT part, 'k' AS kernel, launched, launched AS live, CASE WHEN NOT launched OR way = 3 THEN 0 WHEN host = 8 THEN 3 ELSE 1 END AS timed, deadly FROM pf WHERE fault <> 0
  UNION ALL SELECT part, 'dev', false, called AND launched, 0, deadly FROM pf WHERE fault <> 0 AND (called OR second = 1))
SELECT part, kernel, launched, live, timed::BIGINT AS timed, CASE WHEN NOT live THEN deadly END AS dead FROM u""")
def kernel_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kernels may be launched, which are in the timed path and which are dead: all programs' call graphs closed together."""
    return S.kernel_uses(programs(spark, sf_dir), "part")


_IDS = sorted(S.CHECKS)


@query(f"""WITH {PROGRAMS_SQL}, {WITH.removeprefix("WITH ")},
f AS (SELECT c.correct::INT AS y, c.speedup, i.id AS check_id, EXISTS (SELECT 1 FROM found WHERE found.part = c.part_id AND found.check_id = i.id) AS flagged FROM candidates c, (SELECT unnest({_IDS}) AS id) i)
SELECT check_id, count(*) AS n, round((avg(flagged::INT))::DECIMAL(20, 14), 4)::DOUBLE AS rate, round((avg(y) FILTER (flagged))::DECIMAL(20, 14), 4)::DOUBLE AS correct_flagged, round((avg(y) FILTER (NOT flagged))::DECIMAL(20, 14), 4)::DOUBLE AS correct_clean,
  round((median(speedup) FILTER (flagged))::DECIMAL(20, 14), 4)::DOUBLE AS speedup_flagged, round((median(speedup) FILTER (NOT flagged))::DECIMAL(20, 14), 4)::DOUBLE AS speedup_clean FROM f GROUP BY check_id""")
def lint_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How attempts that a check flags come off against those that it does not: verdicts of all candidates joined to the findings on their programs."""
    flagged = S.flags(scanned(spark, sf_dir)).drop("source", "report", "size")
    c = candidates(spark, sf_dir).select(F.col("part_id").alias("part"), F.col("correct").cast("int").alias("correct"), "speedup")
    columns = [x.replace(".", "_") for x in _IDS]
    out = S.outcomes(c.join(flagged, "part"), columns, "correct", "speedup")
    return out.withColumn("check_id", F.replace("check_id", F.lit("_"), F.lit(".")))
