"""Hard negatives by bit-sliced integer products.

Components become integers and are read as bit-planes, most significant first. After each plane the score of a pair
lies in an interval: what the planes so far give, plus what the rest could still add at least and at most. A pair goes
as soon as its interval cannot qualify: below the k-th best lower bound of its anchor, or outside the band of scores
that each of the anchor's positives allows. A pair that outlives the last plane has its exact score.

Anchors are a stated query set. They meet all rows in cells of a grid, a block of anchors by a block of rows, both of
bounded bytes and dealt by row number, so labels, ids and repeated vectors make no cell larger than others. A cell
gives back the best few of each of its anchors; a ranked window over these is the result. Two passes: the positives,
then the negatives, whose bands the positives' scores set.

Rows with a null label, a null vector, a null or non-finite component, or one of 65,536 or more in size (2^24 as an
integer) take no part. Vectors of different lengths have no score. A null vec_id is no anchor and comes last in ties;
rows that repeat a vec_id are rows of their own, told apart by their place in the written table; ties of score and
vec_id fall by that place too. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

#: Integers of a cell's rows (16 MB) and of its anchors (2 MB); pairs that a cell looks at together.
ROW_INTS, ANCHOR_INTS, ROWS_AT_ONCE, ANCHORS_AT_ONCE = 1 << 22, 1 << 19, 4096, 128
#: Components stay under 2^24 in size: products of up to 32,767 of them fit 64 bits.
LIMIT_BITS = 24
#: Pairs are kept as a matrix until fewer than one in so many are left, then as a list.
SPARSE = 16


def integer_rows(vectors: DataFrame, scale: int, label: Column, vec: str = "embedding") -> DataFrame:
    """rid, vec_id, label and integer components v of the rows that take part."""
    x = F.col(vec)
    scaled = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << LIMIT_BITS) / scale)
    kept = vectors.where(F.col("label").isNotNull() & x.isNotNull()).where(F.forall(x, fits))
    return kept.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: scaled(c).cast("int")).alias("v"))


def _matrix(rows: pa.Table, dim: int, where: np.ndarray) -> np.ndarray:
    column = rows.column("v").combine_chunks()
    return pc.list_flatten(column.filter(pa.array(where)) if not where.all() else column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(int(where.sum()), dim)


def _dims(rows: pa.Table) -> np.ndarray:
    return pc.list_value_length(rows.column("v")).to_numpy()


def _ids(rows: pa.Table) -> np.ndarray:
    """vec_id for sorting: null last."""
    return pc.fill_null(rows.column("vec_id"), np.iinfo(np.int64).max).to_numpy()


class Planes:
    """Bit-planes of integer vectors in two's complement, the most significant first."""

    def __init__(self, v: np.ndarray, bits: int, kind: type):
        self.v, self.bits, self.kind = v, bits, kind

    def plane(self, j: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return ((self.v[at] >> j) & 1).astype(self.kind)

    def weight(self, j: int) -> int:
        return -(1 << j) if j == self.bits - 1 else 1 << j


def _number(a: np.ndarray, bits: int) -> type:
    """The fastest number type in which all sums that occur are exact."""
    most = int(np.abs(a).sum(axis=1, initial=0).max(initial=0)) << (bits + 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _kth(group: np.ndarray, value: np.ndarray, k: int, groups: int, floor: np.ndarray) -> np.ndarray:
    """For each group the k-th largest value, or ``floor`` where it has fewer or this is more."""
    order = np.lexsort((-value, group))
    g = group[order]
    first = np.searchsorted(g, np.arange(groups))
    at = first + k - 1
    has = (at < len(g)) & (g[np.minimum(at, max(len(g) - 1, 0))] == np.arange(groups)) if len(g) else np.zeros(groups, bool)
    out = floor.copy()
    out[has] = np.maximum(out[has], value[order][at[has]])
    return out


def survivors(a: np.ndarray, rows: np.ndarray, mask: np.ndarray, bits: int, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Pairs of ``mask`` that can be among the first k of one of the bands [low, high] of their anchor (arrays anchors x bands).

    ``floor``: what the k-th of each band has been so far. Gives anchor, row and score of each pair, and how many pairs were left after each plane.
    """
    kind = _number(a, bits)
    af, planes, left = a.astype(kind), Planes(rows, bits, kind), []
    plus, minus = np.maximum(af, 0).sum(axis=1), np.minimum(af, 0).sum(axis=1)
    bound = np.maximum(low, floor)
    part, pairs = np.zeros(mask.shape, kind), None
    for j in range(bits - 1, -1, -1):
        rest = (1 << j) - 1
        if pairs is None:
            part += planes.weight(j) * (af @ planes.plane(j).T)
            lower, upper = part + rest * minus[:, None], part + rest * plus[:, None]
            width = rest * (plus - minus)
            for b in range(low.shape[1]):
                if (width <= high[:, b] - low[:, b]).any() and mask.shape[1] >= k:
                    sure = mask & (lower >= low[:, [b]]) & (upper <= high[:, [b]])
                    best = np.partition(np.where(sure, lower, -(1 << 62)), -k, axis=1)[:, -k]
                    bound[:, b] = np.maximum(bound[:, b], best.astype(np.int64))
            mask &= (upper >= bound.min(axis=1)[:, None]) & (lower <= high.max(axis=1)[:, None])
            if j and mask.sum() * SPARSE > mask.size:
                left.append(int(mask.sum()))
                continue
            x, y = np.nonzero(mask)
            pairs, value = (x, y), part[x, y]
        else:
            x, y = pairs
            value = value.copy()
            for s in range(0, len(x), 1 << 16):
                at = slice(s, s + (1 << 16))
                value[at] += planes.weight(j) * (af[x[at]] * planes.plane(j, y[at])).sum(axis=1)
        lower, upper = value + rest * minus[x], value + rest * plus[x]
        alive = np.zeros(len(x), bool)
        for b in range(low.shape[1]):
            sure = (lower >= low[x, b]) & (upper <= high[x, b])
            bound[:, b] = _kth(x[sure], lower[sure].astype(bound.dtype), k, len(a), bound[:, b])
            alive |= (upper >= bound[x, b]) & (lower <= high[x, b])
        pairs, value = (x[alive], y[alive]), value[alive]
        left.append(int(alive.sum()))
    return *pairs, value.astype(np.int64), left


class Best:
    """The first k rows of each (anchor, band) so far: by score, then vec_id, then rid."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, np.iinfo(np.int64).min // 4, np.int64)
        self.rows = np.zeros((0, 4), np.int64)  # group, score, vec_id, rid

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, rid: np.ndarray) -> None:
        all_ = np.concatenate([self.rows, np.stack([group, score, vec_id, rid], axis=1)])
        all_ = all_[np.lexsort((all_[:, 3], all_[:, 2], -all_[:, 1], all_[:, 0]))]
        place = np.arange(len(all_)) - np.searchsorted(all_[:, 0], all_[:, 0])
        self.rows = all_[place < self.k]
        last = all_[place == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]


def _cell(anchors: pa.Table, rows: pa.Table, bits: int, k: int, same: bool) -> pa.Table:
    """Of each anchor of the cell the first k rows of its label (``same``), or of other labels for each of its bands."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(anchors) or not len(rows):  # a side without rows has no columns either
        return pa.table({c: pa.array([], t) for c, t in (("anchor", pa.int64()), ("band", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("rid", pa.int64()))})
    dims_a, dims_r = _dims(anchors), _dims(rows)
    for dim in np.intersect1d(dims_a, dims_r):
        wa, wr = dims_a == dim, dims_r == dim
        at, ar = np.flatnonzero(wa), np.flatnonzero(wr)
        a, r = _matrix(anchors, int(dim), wa), _matrix(rows, int(dim), wr)
        la, lr = anchors.column("label").to_numpy()[at], rows.column("label").to_numpy()[ar]
        ida, idr, vid = anchors.column("rid").to_numpy()[at], rows.column("rid").to_numpy()[ar], _ids(rows)[ar]
        if same:  # rows and anchors of one label stand together: what cannot pair is not multiplied
            oa, orow = np.argsort(la, kind="stable"), np.argsort(lr, kind="stable")
            a, la, at, ida = a[oa], la[oa], at[oa], ida[oa]
            r, lr, ar, idr, vid = r[orow], lr[orow], ar[orow], idr[orow], vid[orow]
            bands = 1
        else:
            scores = anchors.column("scores").combine_chunks().filter(pa.array(wa)).to_pylist()
            bands = max(map(len, scores))
        for s in range(0, len(a), ANCHORS_AT_ONCE):
            sa = slice(s, s + ANCHORS_AT_ONCE)
            n = len(la[sa])
            low, high = np.full((n, bands), np.iinfo(np.int64).min // 4, np.int64), np.full((n, bands), np.iinfo(np.int64).max // 4, np.int64)
            if not same:
                low[:], high[:] = 1, 0  # a band that no score is in
                for i, own in enumerate(scores[sa]):
                    low[i, : len(own)], high[i, : len(own)] = [x["low"] for x in own], [x["high"] for x in own]
            best = Best(n * bands, k)
            lo, hi = (np.searchsorted(lr, la[sa].min()), np.searchsorted(lr, la[sa].max(), "right")) if same else (0, len(r))
            for t in range(lo, hi, ROWS_AT_ONCE):
                sr = slice(t, min(t + ROWS_AT_ONCE, hi))
                mask = la[sa][:, None] == lr[None, sr]
                mask = mask & (ida[sa][:, None] != idr[None, sr]) if same else ~mask
                x, y, score, _ = survivors(a[sa], r[sr], mask, bits, low, high, best.floor.reshape(n, bands), k)
                for b in range(bands):
                    inside = (score >= low[x, b]) & (score <= high[x, b])
                    best.add(x[inside] * bands + b, score[inside], vid[sr][y[inside]], idr[sr][y[inside]])
            group, score, vec_id, rid = best.rows.T
            out.append((at[sa][group // bands], group % bands, np.stack([score, vec_id], axis=1), rid))
    if not out:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64))]
    x, band, values, rid = (np.concatenate(c) for c in zip(*out, strict=True))
    vec_id = pa.array(values[:, 1], mask=values[:, 1] == np.iinfo(np.int64).max)
    return pa.table({"anchor": anchors.column("rid").take(pa.array(x)), "band": pa.array(band, pa.int32()), "score": values[:, 0], "vec_id": vec_id, "rid": rid})


CELL = "anchor long, band int, score long, vec_id long, rid long"


def _grid(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], bits: int, k: int, same: bool) -> DataFrame:
    """Each block of anchors with each block of rows, in a task of its own."""
    n_anchor, n_row = blocks
    dealt = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("ab", dealt(n_anchor)).withColumn("rb", every(n_row))
    right = rows.withColumn("rb", dealt(n_row)).withColumn("ab", every(n_anchor))
    right = right.select("ab", "rb", *[F.col(c).alias(f"row_{c}") for c in rows.columns])  # both sides come from one table
    cell = lambda a, r: _cell(a, r.rename_columns([c.removeprefix("row_") for c in r.column_names]), bits, k, same)
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(cell, CELL)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key over all cells (Spark limits each task's own before the shuffle)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), vec: str = "embedding") -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of other labels with percent[0] * positive_score <= 100 * negative_score <= percent[1] * positive_score."""
    spark = vectors.sparkSession
    rows = materialize(integer_rows(vectors, scale, label, vec), "negatives-rows")
    size = rows.agg(F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("ints"), F.count("rid").alias("n"), F.coalesce(F.sum(F.when(is_anchor, F.size("v"))), F.lit(0)).alias("anchor_ints")).first()
    bits = 1 + max((size["most"] or 0).bit_length(), (~min(size["least"] or 0, 0)).bit_length())
    least = min(2 * spark.sparkContext.defaultParallelism, -(-size["n"] // 1024))
    blocks = max(1, -(-size["anchor_ints"] // ANCHOR_INTS)), max(1, least, -(-size["ints"] // ROW_INTS))
    anchors = rows.where(is_anchor)
    near = _first(_grid(anchors, rows, blocks, bits, positives, True), ["anchor"], positives)
    low, high = (F.lit(x) * F.col("score") for x in percent)
    down = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))  # noqa: E731  in whole numbers: a double has 53 bits
    banded = near.select("anchor", F.struct("rank", "vec_id", "score", (-down(-low)).alias("low"), down(high).alias("high")).alias("p"))
    banded = banded.groupBy("anchor").agg(F.sort_array(F.collect_list("p")).alias("scores"))  # ``positives`` of them at most
    known = materialize(anchors.join(banded, anchors.rid == banded.anchor).select("rid", "vec_id", "label", "v", "scores"), "negatives-anchors")
    far = _first(_grid(known, rows, blocks, bits, negatives, False), ["anchor", "band"], negatives)
    named = known.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("scores").alias("band", "p"))
    out = named.join(far, ["anchor", "band"])
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
