"""Command line: list queries, run one over a folder of tables, scan programs, show settings, and print reports.

python -m tallyloom list | run QUERY SF_DIR [--out DIR] [--rows N] | explain QUERY SF_DIR | scan DIR --out DIR | report DIR [--references DIR] [--baseline F] | build OUT RUN ... --baseline F [--exclude F] [--set KEY=VALUE ...] | gates OUT RUN ... [--set KEY=VALUE ...] | settings [--file F] [KEY=VALUE ...]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession


def text_table(df: DataFrame, n: int = 50) -> str:
    """The first ``n`` rows as text: columns under their names, numbers to the right, null as n/a."""
    rows = df.limit(n).collect()
    show = lambda v: "n/a" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v)
    cells = [[show(r[c]) for c in df.columns] for r in rows]
    number = [all(isinstance(r[c], (int, float)) or r[c] is None for r in rows) for c in df.columns]
    width = [max([len(c), *(len(x[i]) for x in cells)]) for i, c in enumerate(df.columns)]
    line = lambda x: "  ".join(v.rjust(w) if num else v.ljust(w) for v, w, num in zip(x, width, number, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, cells)])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name in ("run", "explain"):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("sf_dir")
    sub.choices["run"].add_argument("--out", help="write Parquet here instead of printing")
    sub.choices["run"].add_argument("--rows", type=int, default=50, help="rows to print")
    s = sub.add_parser("scan", help="static checks over the *_kernel.py files of a folder")
    s.add_argument("folder")
    s.add_argument("--out", required=True)
    r = sub.add_parser("report", help="static checks of a run folder against its verdicts")
    r.add_argument("folder")
    r.add_argument("--references")
    r.add_argument("--baseline")
    for name, text in (("build", "parts of labelled attempts from run folders"), ("gates", "whether a built corpus may be used")):
        b = sub.add_parser(name, help=text)
        b.add_argument("out")
        b.add_argument("runs", nargs="+")
        b.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE")
    sub.choices["build"].add_argument("--baseline", required=True)
    sub.choices["build"].add_argument("--exclude")
    c = sub.add_parser("settings", help="settings after a file and overrides")
    c.add_argument("--file")
    c.add_argument("overrides", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command and returns what it prints."""
    a = parser().parse_args(argv)
    if a.command == "settings":
        from .config import flat, load

        return json.dumps(flat(load(a.file, a.overrides)), indent=1)
    from .plans import registry

    if a.command == "list":
        return "\n".join(sorted(registry.QUERIES))
    spark = spark or SparkSession.builder.appName("tallyloom").getOrCreate()
    if a.command == "scan":
        from .operators.staticcheck import scan
        from .sources.readers import kernel_files

        scan(kernel_files(spark, a.folder), "source").write.mode("overwrite").json(a.out)
        return text_table(spark.read.json(a.out).groupBy("report.parse_status").count())
    if a.command == "report":
        from .sources import readers, scans

        base = readers.baseline_times(spark, a.baseline) if a.baseline else None
        rows = scans.outcome_rows(spark, a.folder, scans.scan_run(spark, a.folder, a.references), base)
        return text_table(scans.outcome_report(rows).orderBy("check_id"))
    if a.command in ("build", "gates"):
        from .config import load
        from .sources import corpus

        conf = load(overrides=a.set)
        if a.command == "gates":
            return text_table(corpus.corpus_checks(spark, a.out, a.runs, conf.labels, conf.cuts))
        m = corpus.build_corpus(spark, a.runs, a.out, a.baseline, a.exclude, conf.labels, conf.cuts)
        return json.dumps({k: m[k] for k in ("attempts", "counts", "units_built", "units_reused", "skipped_units")}, indent=1)
    if a.query not in registry.QUERIES:
        raise SystemExit(f"no query {a.query!r}; see list")
    df = registry.QUERIES[a.query](spark, a.sf_dir)
    if a.command == "explain":
        return df._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
        return a.out
    return text_table(df, a.rows)
