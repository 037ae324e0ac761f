"""N-gram Jaccard join by set relations (operator 5): exact, with skipping.

A document's set holds its distinct ``k``-word shingles. Equal sets form a class; all
that follows works on classes, so exact copies cost one. No step emits a pair of sets:
tasks join up the members they hold and emit one edge for each member at most.

1. Order. Shingles that many documents share go last, by their counts; all others by
   hash. Batches report the shingles that they hold twice or more; the counts are summed,
   and the ``MAX_HEAVY`` most frequent of ``HEAVY`` or more are late. They only shape the
   order: any choice gives the same result.
2. Lists. Two sets that link share a shingle in their prefixes (the first
   n - ceil(0.85 n) + 1 in this order), so prefixes make the inverted lists, in order of
   set size. They are dealt by ranges of (shingle, size, class), so a list held by a third of all
   documents spreads over tasks. Lists of one are dropped; the rest is cut into blocks.
3. Neighbourhoods. Within a block, members are joined up if a shared list, their sizes,
   the places of the shared shingle and the parity sketches of their sets (whose
   differing bits bound the difference from below) allow a link. Blocks of one list are compared with the
   next block, and with all others only where that leaves their members apart: pairs of
   blocks are skipped on their bounds (size, place, neighbourhood).
4. Answers. A neighbourhood's full sets meet in one task (large ones in blocks and pairs of
   blocks, skipped whole where both belong to one component). A set's overlaps with all
   others come from an inverted index; a set much like the one before has its answer derived from
   that one's, by the lists of members that only one of the two has. Sets that are joined up with all their
   possible partners are skipped.
5. Links make components.

Nulls: a null text has the empty set, which links with nothing; a null doc_id takes
part and is never a component's id unless no other is there. Repeated rows and equal texts
share a class and a component. Very long texts are taken whole: a task holds one text and one block at a time. Ties: the smallest doc_id names a
component. Other columns are ignored by the join; ``keep_one`` keeps them, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import setjoin
from .components import components
from .runtime import FILTER_BITS, bitmaps, drop, drop_since, holds, mark, materialize, release, row_key
from .textscan import LOWER, NON_SPACE, Words, mix, slices

HEAVY, MAX_HEAVY = 12, 1 << 19
#: Members of a block of an inverted list or of a neighbourhood, and members of all its sets, about.
BLOCK, TOKENS = 1024, 1 << 19


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer than k words has its whole sequence."""
    at, h = w.windows(k)
    first = np.searchsorted(at, w.first)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = dict(zip(short.tolist(), w.hash_of(w.first[short], w.first[short + 1]), strict=True)) if len(short) else {}
    return [np.array([whole[r]], np.uint64) if r in whole else np.unique(h[first[r] : first[r + 1]]) for r in range(w.rows)]


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        x = mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix(s)) * np.uint64(len(s) | 1)
    return int(mix(np.array([x]))[0].view(np.int64)) if len(s) else 0


def _sketch(k: int):
    """Rows (d, t, doc_id, n, c) of documents, and (token, heavy) of shingles that a batch holds often."""

    def run(batches):
        for batch in batches:
            n, c, sets = [], [], []
            for _, _, w in slices(batch.column("text"), NON_SPACE, LOWER):
                for s in shingle_sets(w, k):
                    n.append(len(s))
                    c.append(class_of(s))
                    sets.append(s)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("t"), batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(c, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                names=["d", "t", "doc_id", "n", "c", "token", "heavy"],
            )
            if rows:
                every, count = np.unique(np.concatenate(sets), return_counts=True)
                often = count > 1
                every, count = every[often], count[often]
                m = len(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(every.view(np.int64)), pa.array(count, pa.int64())],
                    names=["d", "t", "doc_id", "n", "c", "token", "heavy"],
                )

    return run


def _ordered(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set with its heavy members (``heavy``: sorted) last, in order of ``rank``."""
    if not len(heavy) or not len(s):
        return s
    i = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    late = heavy[i] == s
    return np.concatenate([s[~late], s[late][np.argsort(rank[i[late]])]])


def _prefixes(k: int, percent: int, heavy: np.ndarray, rank: np.ndarray):
    """(c, n, prefix, bits): the packed prefix and sketch of each row's set."""

    def run(batches):
        for batch in batches:
            c, n, out, bits = [], [], [], []
            for _, _, w in slices(batch.column("text"), NON_SPACE, LOWER):
                for s in shingle_sets(w, k):
                    if len(s):
                        c.append(class_of(s))
                        n.append(len(s))
                        out.append(_ordered(s, heavy, rank)[: len(s) - (percent * len(s) + 99) // 100 + 1].tobytes())
                        bits.append(setjoin.sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(out, pa.binary()), pa.array(bits, pa.binary())], names=["c", "n", "prefix", "bits"])

    return run


def _entries(batches):
    """(token, c, n, pos): the inverted lists."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        total = int(size.sum())
        c, n = np.repeat(batch.column("c").to_numpy(), size), np.repeat(batch.column("n").to_numpy(), size)
        pos = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        token = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(c), pa.array(n), pa.array(pos.astype(np.int32))], names=["token", "c", "n", "pos"])


def _full_sets(k: int, wanted: bytes):
    """(d, t, members): the sets of rows whose slot is in the bitmap ``wanted``."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(holds(wanted, batch.column("slot").to_numpy())))
            out = [s.tobytes() for _, _, w in slices(batch.column("text"), NON_SPACE, LOWER) for s in shingle_sets(w, k)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), pa.array(out, pa.binary())], names=["d", "t", "members"])

    return run


def _slot():
    return F.pmod(F.xxhash64("d", "t"), F.lit(1 << FILTER_BITS)).alias("slot")


def _cut(block: int):
    """(token, unit, edge, c, n, pos) from lists in order: lists of one fall out, but for the first and last of a partition, whose other members may stand in the next; ``unit`` names runs of ``block`` rows at most; ``edge``: the list may hold rows of other units."""

    def run(batches):
        part = TaskContext.get().partitionId() << 40
        unit, held, first, split = part, None, True, False

        def emit(x, keep_last: bool):
            """Complete lists of x; the last one too, where no more rows can come."""
            nonlocal unit, first, split
            token = x[0]
            begin = np.flatnonzero(np.diff(token, prepend=token[:1] - 1))
            size = np.diff(np.append(begin, len(token)))
            edge = size > block
            if first or split:
                edge[0] = True
            if keep_last:
                edge[-1] = True
            keep = np.repeat((size > 1) | edge, size)
            edge = np.repeat(edge, size)[keep]
            x = [y[keep] for y in x]
            first = split = False
            # units: a list goes on in the unit of the one before while both fit
            unit += 1
            at = np.arange(len(x[0]))
            units = unit + at // block
            unit += len(at) // block
            cut = np.flatnonzero(np.diff(units))
            # lists that a unit's end cuts hold rows of two units
            for i in cut:
                if x[0][i] == x[0][i + 1]:
                    edge[x[0] == x[0][i]] = True
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(units), pa.array(edge), *(pa.array(y) for y in x[1:])], names=["token", "unit", "edge", "c", "n", "pos"])

        for batch in batches:
            x = [batch.column(name).to_numpy() for name in ("token", "c", "n", "pos")]
            x = [np.concatenate([p, q]) for p, q in zip(held, x, strict=True)] if held else x
            if not len(x[0]):
                continue
            last = int(np.searchsorted(x[0], x[0][-1], "left"))
            if last:
                yield emit([y[:last] for y in x], False)
            held = [y[last:] for y in x]
            whole = len(held[0]) // block * block
            if whole > block:  # a list longer than a block goes out piece by piece
                out = emit([y[:whole] for y in held], True)
                yield out
                held, split = [y[whole:] for y in held], True
                if not len(held[0]):
                    held = None
        if held:
            yield emit(held, True)

    return run


def _runs(batches, keys: list[str]):
    """Tables of consecutive rows with equal keys."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([np.diff(x) != 0 for x in cols], axis=0)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            key = tuple(x[a] for x in cols)
            if key != name and held:
                yield pa.Table.from_batches(held)
                held = []
            name = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _tree(c: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    child = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(c[child]), pa.array(c[label[child]])], names=["a", "b"])


def _same(label: np.ndarray) -> np.ndarray:
    """For each value the place of the first one equal to it."""
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    return first[of]


def _near(percent: int, keys: list[str]):
    """(a, b): members of a block, or of two blocks of a list (column ``side``), joined up where a link is possible."""

    def run(batches):
        for t in _runs(batches, keys):
            token, c, n, pos = (t.column(x).to_numpy() for x in ("token", "c", "n", "pos"))
            side = t.column("side").to_numpy() if "side" in t.column_names else None
            members, first, who = np.unique(c, return_index=True, return_inverse=True)
            label = _same(t.column("label").to_numpy()[first]) if "label" in t.column_names else np.arange(len(members))
            bits = t.column("bits").take(pa.array(first)).to_pylist()
            yield _tree(members, setjoin.candidates(token, who, n, pos, None if side is None else side == 1, setjoin.Sketches(bits), label, percent))

    return run


def _exact(percent: int):
    """(a, b): members of a neighbourhood's block (x = y), or of two blocks, joined up by links."""

    def run(batches):
        for t in _runs(batches, ["root", "x", "y"]):
            c = t.column("c").to_numpy()
            right = t.column("block").to_numpy() == t.column("y").to_numpy() if t.column("x")[0] != t.column("y")[0] else None
            sets = [np.frombuffer(s, np.uint64) for s in t.column("members").to_pylist()]
            yield _tree(c, setjoin.answers(sets, right, _same(t.column("label").to_numpy()), percent))

    return run


def _grouped(rows: DataFrame, by: list[str], then: list[str]) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, *then)


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``label``: the component of c, or c itself."""
    return rows.join(roots.select(F.col("node").alias("c"), F.col("root").alias("label")), "c", "left").withColumn("label", F.coalesce("label", "c"))


def neighbourhoods(packed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, root) of the classes that share a list with another one that they may link with."""
    entries = packed.select("c", "n", "prefix").mapInArrow(_entries, "token long, c long, n int, pos int")
    lists = entries.repartitionByRange("token", "n", "c").sortWithinPartitions("token", "n", "c").mapInArrow(_cut(block), "token long, unit long, edge boolean, c long, n int, pos int")
    lists = materialize(lists, "lists")
    bits = packed.select("c", "bits")
    edges = _grouped(lists.join(bits, "c"), ["unit"], ["token", "n", "c"]).mapInArrow(_near(percent, ["unit"]), "a long, b long")
    edges = materialize(edges, "near")
    # blocks of one list: each with the next one, then all others that are still apart
    cut = materialize(lists.where("edge").select("token", "unit", "c", "n", "pos"), "cut")
    parts = cut.groupBy("token", "unit").agg(F.min("n").alias("n0"), F.max("n").alias("n1"))
    order = Window.partitionBy("token").orderBy("unit")
    parts = materialize(parts.withColumn("i", F.row_number().over(order)).withColumn("more", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("more > 1"), "parts")
    if parts.isEmpty():
        return components(edges)

    def across(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Edges between the blocks of ``pairs`` (token, x, y: units)."""
        sides = [cut.join(pairs.select("token", F.col(u).alias("unit"), "x", "y"), ["token", "unit"]).withColumn("side", F.lit(i)) for i, u in enumerate(("x", "y"))]
        rows = _labelled(sides[0].unionByName(sides[1]), label).join(bits, "c")
        return _grouped(rows, ["token", "x", "y"], ["n", "c"]).mapInArrow(_near(percent, ["token", "x", "y"]), "a long, b long")

    p = parts.select("token", "i", F.col("unit").alias("x"), "n1")
    q = parts.select("token", (F.col("i") - 1).alias("i"), F.col("unit").alias("y"), "n0")
    chain = p.join(q, ["token", "i"]).where(f"100 * n1 >= {percent} * n0").select("token", "x", "y")
    edges = materialize(edges.unionByName(across(chain, components(edges))), "near")
    roots = components(edges)
    own = _labelled(cut, roots).groupBy("token", "unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("pos").alias("p1"), F.max(F.col("n") - F.col("pos")).alias("l1"))
    own = materialize(parts.join(own, ["token", "unit"]), "parts")
    x, y = own.alias("p"), own.alias("q")
    rest = x.join(
        y,
        F.expr(f"""p.token = q.token AND p.i + 1 < q.i AND 100 * p.n1 >= {percent} * q.n0
            AND NOT (p.lo = p.hi AND q.lo = q.hi AND p.lo = q.lo)
            AND {100 + percent} * (least(p.p1, q.p1) + least(p.l1, q.l1)) >= {percent} * (p.n0 + q.n0)"""),
    )
    rest = rest.select("p.token", F.col("p.unit").alias("x"), F.col("q.unit").alias("y"))
    return components(edges.unionByName(across(rest, roots)))


def _blocks(place: DataFrame, by: list[str], tokens: int, members: int) -> DataFrame:
    """``place`` with block: members dealt by hash to as many blocks of each group as its size asks for."""
    size = place.groupBy(*by).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("count"))
    size = size.select(*by, F.greatest(F.ceil(F.col("tokens") / tokens), F.ceil(F.col("count") / members)).cast("int").alias("blocks")).where("blocks > 1")
    return place.join(materialize(size, "sizes"), by, "left").withColumn("block", F.pmod(F.xxhash64("c"), F.coalesce("blocks", F.lit(1))).cast("int"))


def link(docs: DataFrame, k: int = 4, percent: int = 85, block: int = BLOCK, tokens: int = TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, roots): d, t, doc_id, n, c (class of its set, 0 for none) of every row of ``docs``; id, n, d, t of each class c; and (node, root) of the classes joined up by links."""
    spark = docs.sparkSession
    keyed = docs.select(*row_key(), "doc_id", "text")
    sketch = materialize(keyed.select("d", "t", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(k), "d long, t int, doc_id long, n int, c long, token long, heavy long"), "sketch")
    rows = materialize(sketch.where("token IS NULL").select("d", "t", "doc_id", "n", "c"), "rows")
    heavy = sketch.where("token IS NOT NULL").groupBy("token").agg(F.sum("heavy").alias("n")).where(F.col("n") >= HEAVY)
    heavy = np.array([r["token"] for r in heavy.orderBy(F.desc("n"), "token").limit(MAX_HEAVY).collect()], np.int64).view(np.uint64)
    by = np.argsort(heavy)
    drop(sketch)
    # the most frequent ones last
    heavy, rank = heavy[by], (len(heavy) - by).astype(np.int32)
    classes = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.min(F.struct("d", "t")).alias("r"))
    classes = materialize(classes.select("c", "id", "n", "r.d", "r.t"), "classes")

    packed = docs.select("text").mapInArrow(_prefixes(k, percent, heavy, rank), "c long, n int, prefix binary, bits binary").dropDuplicates(["c"])
    packed = materialize(packed, "packed")
    release(spark)
    since = mark()
    near = neighbourhoods(packed, percent, block)

    schema = "a long, b long"
    near = materialize(classes.join(near.withColumnRenamed("node", "c"), "c").select("c", "n", "root", "d", "t"), "place")
    drop_since(since)
    drop(packed)
    place = materialize(_blocks(near, ["root"], tokens, block), "place")
    # a bitmap lets most texts fall out where they are read; the join settles the rest
    wanted = bitmaps(place.select(F.lit(0).alias("kind"), _slot()), 1)[0]
    sets = keyed.select("d", "t", "text", _slot()).mapInArrow(_full_sets(k, wanted), "d long, t int, members binary")
    sets = materialize(sets.join(place.select("c", "d", "t"), ["d", "t"]).dropDuplicates(["c"]).select("c", "members"), "sets")
    release(spark)
    held = place.select("c", "n", "root", "block", F.coalesce("blocks", F.lit(1)).alias("blocks")).join(sets, "c").withColumn("label", F.col("c"))
    pairs = "filter(array(struct(block AS x, block AS y), struct(block AS x, block + 1 AS y), struct(block - 1 AS x, block AS y)), p -> p.x >= 0 AND p.y < blocks)"
    held = held.withColumn("p", F.explode(F.expr(pairs))).select("root", "p.x", "p.y", "block", "c", "members", "label")
    links = materialize(_grouped(held, ["root", "x", "y"], ["c"]).mapInArrow(_exact(percent), schema), "links")
    roots = components(links)
    large = place.where("blocks > 2").select("c", "n", "root")
    if large.isEmpty():
        drop(sets)
        return rows, classes, roots

    # neighbourhoods of many blocks: large components get blocks of their own, and pairs of blocks of one component are skipped
    large = materialize(_labelled(large, roots), "large")
    families = large.groupBy("root", "label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= block).select("root", "label", F.col("label").alias("family"))
    large = large.join(materialize(families, "families"), ["root", "label"], "left").withColumn("family", F.coalesce("family", F.lit(-(1 << 63))))
    large = materialize(_blocks(materialize(large, "large"), ["root", "family"], tokens, block).withColumn("block", F.xxhash64("family", "block")), "large")
    kinds = materialize(large.groupBy("root", "family", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "kinds")
    x, y = kinds.alias("p"), kinds.alias("q")
    rest = x.join(y, F.expr("p.root = q.root AND p.block <= q.block AND NOT (p.lo = p.hi AND q.lo = q.hi AND p.lo = q.lo)"))
    rest = rest.select("p.root", F.col("p.block").alias("x"), F.col("q.block").alias("y"))
    sides = rest.select("root", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    held = large.select("root", "block", "c", "label").join(sides, ["root", "block"]).join(sets, "c").select("root", "x", "y", "block", "c", "members", "label")
    more = _grouped(held, ["root", "x", "y"], ["c"]).mapInArrow(_exact(percent), schema)
    return rows, classes, components(links.unionByName(more))


def join_components(docs: DataFrame, k: int = 4, percent: int = 85, block: int = BLOCK, tokens: int = TOKENS) -> DataFrame:
    """d, t, doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text), and root, which tells components apart where ids are null or repeated (null for the empty set)."""
    rows, classes, roots = link(docs, k, percent, block, tokens)
    named = materialize(_labelled(classes.select("c", "id"), roots).withColumnRenamed("label", "root"), "named")
    ids = materialize(named.groupBy("root").agg(F.min("id").alias("component_id")), "ids")
    named = materialize(named.select("c", "root").join(ids, "root"), "named")
    out = rows.where("n > 0").join(named, "c").select("d", "t", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "root")
    return out.unionByName(rows.where("n = 0").select("d", "t", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stand for their component: its smallest doc_id, once; rows with the empty set stay. All columns are kept."""
    own = docs.columns
    parts = materialize(join_components(docs, k, percent).where("n_shingles > 0"), "parts")
    # one row for each component, nulls last; among repeated ids the smallest text hash stands, once
    lead = parts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t", "d")).alias("x")).select("x.d", "x.t", F.lit(True).alias("lead"))
    member = parts.select("d", "t").distinct().join(lead, ["d", "t"], "left")
    # the caller's row as one column, so that no name can clash
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    rows = docs.select(row, *row_key()).join(member.withColumn("set", F.lit(True)), ["d", "t"], "left").where("lead OR set IS NULL")
    alone = rows.where("set IS NULL").select("row.*")
    first = Window.partitionBy("d", "t").orderBy(*[F.col(f"row.`{c}`") for c in own if c != "text" and not isinstance(docs.schema[c].dataType, MapType)])
    pick = rows.where("lead").withColumn("i", F.row_number().over(first)).where("i = 1").select("row.*")
    return pick.unionByName(alone)
