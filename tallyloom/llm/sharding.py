"""Size-balanced sharding by sampled splitters (operator 4).

Records are ordered by (hash of the text, hash of the doc_id, place in the input), so
equal texts are neighbours and no two records share a key. A size-weighted sample of keys (each row with probability proportional
to its size, from a hash) gives quantile boundaries; they cut the
order into many fine ranges. Ranges that hold over twice the mean beside their largest record are
sampled again and subdivided, inside a run of equal texts where that run itself is
too large, until none is left. Consecutive ranges then fill the shards to equal bytes.

What reaches the driver is bounded: about ``SAMPLES_PER_RANGE`` sampled keys and one
count for each range. Slots are numbered range by range, never a shard in one task.

Nulls: a null text has no bytes (CRC 0); a null doc_id is kept. Equal rows are
separate records and ties are broken by their place in the input, so however many there are, they spread over
ranges, tasks and shards. A very long text is one record: texts are only measured, and its shard is over the mean by
less than its size. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

OVERHEAD = 8
#: Fine ranges for each shard at least, and rows of a range at most, about.
RANGES_PER_SHARD = 64
RANGE_ROWS = 500_000
#: Sampled keys for each fine range: bounds what the driver gathers.
SAMPLES_PER_RANGE = 12
_LOW = -(1 << 63)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, h, s, t: the only pass over the texts. ``t`` tells records apart that are equal in all else."""
    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64(text)
    return docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"), F.xxhash64(F.col("doc_id"), h).alias("s"), F.xxhash64(F.monotonically_increasing_id()).alias("t"))


Key = tuple[int, int, int]


def _range_of(cuts: list[Key]):
    """Adds to each row the number of cuts at or below its (h, s, t)."""
    ch, cs, ct = (np.array([c[i] for c in cuts], np.int64) for i in range(3))
    heads = np.unique(ch)

    def run(batches):
        for batch in batches:
            h, s, t = (batch.column(x).to_numpy() for x in "hst")
            r = np.searchsorted(ch, h, "left").astype(np.int32)
            if len(heads):
                met = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, h), len(heads) - 1)] == h)
                if len(met):
                    # rows whose h is that of a cut: sorted together with those cuts, equal cuts first
                    near = np.flatnonzero(np.isin(ch, h[met]))
                    keys = [np.concatenate([c[near], x[met]]) for c, x in ((ch, h), (cs, s), (ct, t))]
                    is_row = np.repeat([0, 1], [len(near), len(met)])
                    order = np.lexsort((is_row, keys[2], keys[1], keys[0]))
                    passed = np.empty(len(order), np.int64)
                    passed[order] = np.cumsum(is_row[order] == 0)
                    # all cuts below these heads, those that are near being counted in order
                    below = np.searchsorted(ch, h[met], "left") - np.searchsorted(ch[near], h[met], "left")
                    r[met] = below + passed[len(near) :]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "r"])

    return run


def _ranged(m: DataFrame, cuts: list[Key]) -> DataFrame:
    return m.mapInArrow(_range_of(cuts), "doc_id long, size long, text_crc32 long, h long, s long, t long, r int")


def _sample(rows: DataFrame, size: int, n: int, seed: int) -> list[tuple[Key, int]]:
    """About ``n`` keys, each row with probability proportional to its size (those over size / n surely), in order: ((h, s, t), weight)."""
    step = max(1, size // max(1, n))
    u = F.pmod(F.xxhash64("h", "s", "t", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.where(u < F.col("size") / F.lit(float(step))).select("h", "s", "t", F.greatest("size", F.lit(step)).alias("w")).collect()
    return sorted(((r["h"], r["s"], r["t"]), r["w"]) for r in got)


def _quantiles(sample: list[tuple[Key, int]], n: int, inside: bool) -> list[Key]:
    """n - 1 boundaries at equal weight; (h, lowest, lowest) keeps equal texts together unless ``inside``."""
    total, run, out = sum(w for _, w in sample), 0, []
    for key, w in sample:
        if run * n >= total * (len(out) + 1) and len(out) < n - 1:
            out.append(key if inside else (key[0], _LOW, _LOW))
            while run * n >= total * (len(out) + 1) and len(out) < n - 1:
                out.append(out[-1])
        run += w
    return sorted(set(out))


def splitters(m: DataFrame, n_shards: int) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """Boundaries of the fine ranges, and (bytes, rows) of each range that has rows."""
    total, rows = (int(x or 0) for x in m.agg(F.sum("size"), F.count(F.lit(1))).first())
    n = max(n_shards * RANGES_PER_SHARD, rows // RANGE_ROWS)
    cuts = _quantiles(_sample(m, total, n * SAMPLES_PER_RANGE, 0), n, inside=False)
    seed = 0
    while True:
        ranged = _ranged(m, cuts)
        stats = ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"), F.max("size").alias("top")).collect()
        sizes = {x["r"]: (x["b"], x["c"]) for x in stats}
        # a record larger than a range cannot be split; all others of its range can
        full = {x["r"]: x["b"] for x in stats if (x["b"] - x["top"]) * n > 2 * total}
        if not full:
            return cuts, sizes
        over = sum(full.values())
        parts = max(2, 2 * over * n // total)
        seed += 1
        sample = _sample(ranged.where(F.col("r").isin([int(r) for r in full])), over, parts * SAMPLES_PER_RANGE, seed)
        by: dict[int, list] = {}
        for key, w in sample:
            by.setdefault(bisect.bisect_right(cuts, key), []).append((key, w))
        cuts = sorted(set(cuts) | {c for r, xs in by.items() for c in _quantiles(xs, max(2, 2 * full.get(r, 0) * n // total), inside=True)})


def shard_of_ranges(sizes: dict[int, tuple[int, int]], n_shards: int) -> dict[int, tuple[int, int]]:
    """(shard, first slot) of each range: consecutive ranges, each in the shard that holds its middle byte."""
    total, run = sum(b for b, _ in sizes.values()), 0
    filled = [0] * n_shards
    out = {}
    for r in sorted(sizes):
        b, c = sizes[r]
        k = min(n_shards - 1, (2 * run + b) * n_shards // (2 * total))
        out[r] = (k, filled[k])
        filled[k] += c
        run += b
    return out


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text)."""
    m = materialize(measured(docs), "shard")
    cuts, sizes = splitters(m, n_shards)
    place = shard_of_ranges(sizes, n_shards)
    top = max(place, default=0) + 1
    shards, starts = np.full(top, -1, np.int32), np.zeros(top, np.int64)
    for r, (k, first) in place.items():
        shards[r], starts[r] = k, first

    def settle(batches):
        for batch in batches:
            r = batch.column("r").to_numpy()
            cols = {k: batch.column(k) for k in ("doc_id", "size", "text_crc32")}
            slot = starts[r] + batch.column("i").to_numpy() - 1
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(["bytes"] * len(r), pa.string()), pa.array(shards[r]), pa.array(slot, pa.int64()), pa.nulls(len(r), pa.int32())], names=[*cols, "law", "shard", "slot", "grown_shard"])

    ranked = _ranged(m, cuts).withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy("h", "s", "t")))
    return ranked.mapInArrow(settle, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
