"""Who runs whom in programs: edges between functions, and what is reached from an entry by them, for a whole table.

There are two closures, because checks need opposite errors. ``may``: a class that is mentioned may run any of its
methods; a kernel outside of it is dead for sure. ``does``: it runs only what a forward call runs; work outside of it
is certainly not in the timed path. A function that is mentioned, as a callback too, is in both.

``program_edges`` reads one program; ``edges`` does so for a table through an Arrow UDF, and ``reach`` closes all
programs' graphs together: a round joins the last round's new nodes to the edges, for as many rounds as the longest
path, whatever the number of programs. No program is a group: a node is a key of (program, function).
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .kernelflow import dotted, walk

#: What calling a module or an autograd function runs.
PROTOCOL = ("forward", "setup_context", "__call__")
MODULE = "<module>"


def owner(scope: str, classes) -> str:
    """The function or method that a nested scope belongs to."""
    parts = scope.split(".")
    return ".".join(parts[: 2 if parts[0] in classes else 1])


def lineage(program, cls: str | None, seen: frozenset = frozenset()) -> list[str]:
    """A class of the file and its bases in the file, nearest first."""
    node = program.classes.get(cls or "")
    if node is None or cls in seen:
        return []
    return [cls, *(x for b in node.bases for x in lineage(program, dotted(b), seen | {cls}))]


def _methods(program, cls: str, only: tuple[str, ...] | None = None) -> list[str]:
    """Ids of a class's methods, inherited ones where they are not overridden."""
    out: dict[str, str] = {}
    for c in lineage(program, cls):
        for f in program.classes[c].body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and (only is None or f.name in only):
                out.setdefault(f.name, f"{c}.{f.name}")
    return list(out.values())


def attribute_classes(program) -> dict[str, set[str]]:
    """Attributes that hold instances of classes of the file; a parameter's default class counts where the parameter is called or kept."""
    out: dict[str, set[str]] = {}
    for c in program.classes.values():
        for f in (n for n in walk(c) if isinstance(n, ast.FunctionDef)):
            args = [*f.args.posonlyargs, *f.args.args]
            defaults = dict(zip([a.arg for a in args[len(args) - len(f.args.defaults) :]], f.args.defaults, strict=True)) | {a.arg: d for a, d in zip(f.args.kwonlyargs, f.args.kw_defaults, strict=True) if d is not None}
            held = {p: dotted(d) for p, d in defaults.items() if dotted(d) in program.classes}
            for n in walk(f):
                if isinstance(n, ast.Assign):
                    named = {m.id for m in walk(n.value) if isinstance(m, ast.Name)}
                    made = {x for x in named if x in program.classes} | {held[x] for x in named if x in held}
                    for attr in (dotted(t)[5:] for t in n.targets if dotted(t).startswith("self.")):
                        if made:
                            out.setdefault(attr, set()).update(made)
    return out


def functions_of(program) -> dict[str, tuple[ast.AST, str | None]]:
    """Id to (node, class) of module functions and methods."""
    out: dict[str, tuple[ast.AST, str | None]] = {}
    for n in program.tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name not in program.kernels:
            out[n.name] = n, None
    for cname, c in program.classes.items():
        for f in c.body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name not in program.kernels:
                out[f"{cname}.{f.name}"] = f, cname
    return out


def program_edges(program) -> list[tuple[str, str, bool]]:
    """(from, to, does): ``does`` is false for methods that only the ``may`` closure follows."""
    functions, holders, out = functions_of(program), attribute_classes(program), {}

    def link(src: str, dst: str, does: bool) -> None:
        out[src, dst] = out.get((src, dst), False) or does

    def expand(src: str, cls: str) -> None:
        run = set(_methods(program, cls, PROTOCOL))
        for m in _methods(program, cls):
            link(src, m, m in run)

    for fid, (node, cls) in functions.items():
        for n in walk(node):
            name = dotted(n) if isinstance(n, (ast.Name, ast.Attribute)) else ""
            head, _, rest = name.partition(".")
            if not name or (isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)):
                continue
            if name in functions:
                link(fid, name, True)
            if head in program.classes:
                expand(fid, head)
            if head in ("self", "cls") and rest:
                attr = rest.partition(".")[0]
                for c in lineage(program, cls or program.entry):
                    if f"{c}.{attr}" in functions:
                        link(fid, f"{c}.{attr}", True)
                        break
                for c in sorted(holders.get(attr, ())):
                    expand(fid, c)
    return [(a, b, does) for (a, b), does in out.items()]


def entry_of(program) -> str | None:
    """The forward that a run starts from, inherited or not."""
    return next((f"{c}.forward" for c in lineage(program, program.entry) if any(isinstance(f, ast.FunctionDef) and f.name == "forward" for f in program.classes[c].body)), None)


def closure(edges: list[tuple[str, str, bool]], start: str | None, does: bool) -> list[str]:
    """What one program reaches from ``start``, in the order in which it is met."""
    out, todo = [], [start] if start else []
    while todo:
        x = todo.pop(0)
        if x not in out:
            out.append(x)
            todo += [b for a, b, real in edges if a == x and (real or not does)]
    return out


GRAPH = T.StructType(
    [
        T.StructField("entry", T.StringType()),
        T.StructField("has_class", T.BooleanType()),
        T.StructField("kernels", T.ArrayType(T.StringType())),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("does", T.BooleanType())]))),
        T.StructField("launches", T.ArrayType(T.StructType([T.StructField("scope", T.StringType()), T.StructField("kernel", T.StringType()), T.StructField("in_loop", T.BooleanType())]))),
        T.StructField("calls", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())]))),
    ]
)


def reach(starts: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, node): ``starts`` (key, node) and all that edges (key, src, dst) lead to from them. Cycles end: a round keeps only what no round has met."""
    met = fresh = written(starts.select(key, "node").where("node IS NOT NULL").distinct(), "reach")
    while True:
        onward = fresh.join(edges, [fresh[key] == edges[key], fresh["node"] == edges["src"]]).select(fresh[key].alias(key), F.col("dst").alias("node")).distinct()
        fresh = written(onward.join(met, [key, "node"], "left_anti"), "reach")
        if fresh.isEmpty():
            return met
        met = met.unionByName(fresh)


def closures(g: DataFrame, key: str) -> DataFrame:
    """(key, node, does): all functions that may run, and whether a forward call does run them."""
    e = g.select(key, F.explode("edges").alias("e")).select(key, "e.*")
    starts = g.select(key, F.col("entry").alias("node"))
    may, does = reach(starts, e, key), reach(starts, e.where("does"), key)
    return may.join(does.withColumn("does", F.lit(True)), [key, "node"], "left").select(key, "node", F.coalesce("does", F.lit(False)).alias("does"))


def kernel_uses(g: DataFrame, key: str) -> DataFrame:
    """(key, kernel, launched, live, timed, dead): whether a launch of the kernel may run, whether it is live (launched, or called by kernels that are), how many of its launches a forward call runs, and the severity of its being dead: fail, or info where there is a class whose forward is not known; null if live."""
    g = written(g, "graphs")  # read for edges, launches and calls; programs are parsed once
    c = closures(g, key)
    launches = g.select(key, F.explode("launches").alias("x")).select(key, "x.*")
    run = launches.join(c.withColumnRenamed("node", "scope"), [key, "scope"])
    uses = run.groupBy(key, "kernel").agg(F.count_if("does").alias("timed"))
    calls = g.select(key, F.explode("calls").alias("e")).select(key, "e.*")
    live = reach(uses.select(key, F.col("kernel").alias("node")), calls, key).select(key, F.col("node").alias("kernel"), F.lit(True).alias("live"))
    all_ = g.select(key, F.explode("kernels").alias("kernel"), F.when(F.col("entry").isNotNull() | ~F.col("has_class"), "fail").otherwise("info").alias("if_dead"))
    out = all_.join(uses, [key, "kernel"], "left").join(live, [key, "kernel"], "left")
    return out.select(key, "kernel", F.col("timed").isNotNull().alias("launched"), F.coalesce("live", F.lit(False)).alias("live"), F.coalesce("timed", F.lit(0)).alias("timed"), F.when(F.col("live").isNull(), F.col("if_dead")).alias("dead"))
