"""Connected components: contraction within partitions and alternating star steps.

Each round contracts the edges of every partition by least labels (in chunks of a fixed
size, so memory is bounded), then links nodes to the least node of their neighbourhood
(large star, small star). Every step is a partial aggregation and a join of edges; a
round is written to the shared folder, so lineage stays short, and nothing reaches the
driver but a flag. The same steps run at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop, materialize

#: Edges that a task contracts at a time.
CHUNK = 1 << 19


def least_labels(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` (of nodes 0..) lowered until both ends of all edges (a, b) agree and labels point to themselves."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # a label's own node is lowered too, so whole trees move at once
        for x in (a, b):
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, x, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _contract(batches):
    """Edges (u, v) with the same components: each chunk's nodes linked to the least one reachable within it."""

    def flush(us: list, vs: list):
        if not us:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["u", "v"])
        u, v = np.concatenate(us), np.concatenate(vs)
        nodes, i = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = least_labels(i[: len(u)], i[len(u) :], np.arange(len(nodes)))
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[label[child]])], names=["u", "v"])

    us, vs, held = [], [], 0
    for batch in batches:
        us.append(batch.column("u").to_numpy())
        vs.append(batch.column("v").to_numpy())
        held += batch.num_rows
        if held >= CHUNK:
            yield flush(us, vs)
            us, vs, held = [], [], 0
    yield flush(us, vs)


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: links each neighbour above u to u's least neighbour; small: u and those below it."""
    if large:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        out = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every node is the child of one root or a root."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("top")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("top")))
    return ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("top").alias("top")).where("child + top > 1").isEmpty()


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), written, with as many partitions as they fill chunks, contracted and written again."""
    written = materialize(edges, "edges")
    # as few partitions as memory allows: each finds all components of what it holds
    parts = max(1, -(-written.count() // CHUNK))
    out = materialize(written.coalesce(parts).mapInArrow(_contract, "u long, v long"), "edges")
    drop(written)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); root is the least node reachable. Repeated edges and loops change nothing; no edges give no rows."""
    e = _contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(e):
        last, e = e, _contracted(_star(_star(e, True), False))
        drop(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
