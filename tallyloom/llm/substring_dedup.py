"""Substring dedup by fixed-block anchors (operator 6).

A repeated passage of ``window`` words always holds one whole aligned block of
``block = (window + 1) // 2`` words, whichever copy is looked at. So:

1. Every rolling block-sized window of every document probes an index that holds
   only the non-overlapping blocks. Probes and blocks go to the index as 32-bit
   codes, each code once a slice of documents (a passage in a third of all rows
   costs one code a slice), dealt evenly over buckets.
2. A block met twice is an anchor. Only windows that hold an anchor can repeat;
   they get 64-bit hashes, counted exactly. False anchors of the short codes end
   here. This is the extension: the union of repeated windows around an anchor
   is the maximal exact repeat.
3. Words under a repeated window are removed.

Nulls: a null text has no words; a null doc_id is kept. Rows that are equal in
doc_id and text are separate documents, so they repeat each other. Documents
shorter than the window are kept whole. An empty table gives an empty result.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, release, row_key, text_bytes
from .textscan import slices

#: Bytes of text whose probes make one bucket of the block index (about 12 MB of codes).
BUCKET_TEXT_BYTES = 20 << 20


def _codes(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit code of each hash; together they stand for the hash."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _blocks(w, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of all rolling windows, and which of them are aligned blocks (with their words counted from their row's first)."""
    at, h = w.windows(block)
    inside = at - w.first[w.doc[at]]
    return at, h, inside % block == 0, inside


def _send(buckets: int, block: int):
    def run(batches):
        for batch in batches:
            out = {"b": [], "single": [], "many": [], "blocks": []}
            for _, _, w in slices(batch.column("text")):
                _, h, aligned, _ = _blocks(w, block)
                if not len(h):
                    continue
                b, code = _codes(h, buckets)
                key = (b.astype(np.uint64) << np.uint64(32)) | code
                key, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                anchor = np.zeros(len(key), bool)
                anchor[inverse[aligned]] = True
                b, code = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                edges = np.flatnonzero(np.diff(b, prepend=-1, append=buckets))
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    c, many = code[i:j], count[i:j] > 1
                    out["b"].append(int(b[i]))
                    out["single"].append(c[~many].tobytes())
                    out["many"].append(c[many].tobytes())
                    out["blocks"].append(c[anchor[i:j]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["b"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("single", "many", "blocks"))], names=list(out))

    return run


def _meet(table: pa.Table) -> pa.Table:
    """One bucket of the index: codes of blocks that rolling windows meet at least twice."""
    read = lambda k: np.frombuffer(b"".join(table.column(k).to_pylist()), np.uint32)
    index = np.unique(read("blocks"))
    met = np.zeros(len(index), np.int64)
    for k, n in (("single", 1), ("many", 2)):
        if len(index):
            probe = read(k)
            i = np.minimum(np.searchsorted(index, probe), len(index) - 1)
            met += n * np.bincount(i[index[i] == probe], minlength=len(index))
    hit = index[met > 1].astype(np.int64)
    b = table.column("b")[0].as_py() if table.num_rows else 0
    return pa.table({"key": pa.array((np.int64(b) << 32) | hit, pa.int64())})


def _anchors(buckets: int, block: int):
    """Rows (key, d, t, word) for the aligned blocks of every document."""

    def run(batches):
        for batch in batches:
            d, t = batch.column("d").to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False)
            for a, _, w in slices(batch.column("text")):
                at, h, aligned, inside = _blocks(w, block)
                b, code = _codes(h[aligned], buckets)
                row = a + w.doc[at[aligned]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((b << 32) | code.astype(np.int64), pa.int64()), pa.array(d[row], pa.int64()), pa.array(t[row], pa.int32()), pa.array(inside[aligned].astype(np.int32))],
                    names=["key", "d", "t", "word"],
                )

    return run


def _near(window: int, block: int):
    """A row for each slice of documents: the hashes of its windows that hold an anchor, with their rows and start words."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            d, t = batch.column("d").to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False)
            words = batch.column("words")
            for a, b, w in slices(batch.column("text")):
                at, h = w.windows(window)
                anchor = np.zeros(len(w.hash) + 1, np.int32)
                for r in range(a, b):
                    p = np.asarray(words[r].values.to_numpy(zero_copy_only=False), np.int64) + w.first[r - a]
                    lo = np.maximum(p - (window - block), w.first[r - a])
                    np.add.at(anchor, lo, 1)
                    np.add.at(anchor, p + 1, -1)
                keep = np.cumsum(anchor)[at] > 0
                at, h = at[keep], h[keep]
                row = w.doc[at]
                packed = h, row.astype(np.uint32), (at - w.first[row]).astype(np.uint32), d[a:b].astype(np.int64), t[a:b].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["slice", "h", "row", "word", "d", "t"])
                seq += 1

    return run


def _count(buckets: int):
    """Each hash once a slice, with the hashes that the slice has more than once apart."""

    def run(batches):
        for batch in batches:
            for name, h in zip(batch.column("slice").to_pylist(), batch.column("h"), strict=True):
                h, n = np.unique(np.frombuffer(h.as_py(), np.uint64), return_counts=True)
                b = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                b, h, many = b[order], h[order], n[order] > 1
                edges = np.flatnonzero(np.diff(b, prepend=-1, append=buckets))
                parts = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(b[i]) for i, _ in parts], pa.int32()),
                        pa.array([name] * len(parts), pa.int64()),
                        pa.array([h[i:j].tobytes() for i, j in parts], pa.binary()),
                        pa.array([np.packbits(many[i:j]).tobytes() for i, j in parts], pa.binary()),
                    ],
                    names=["b", "slice", "h", "many"],
                )

    return run


def _again(table: pa.Table) -> pa.Table:
    """For each slice of one bucket, a bit for each of its hashes that occurs elsewhere, or twice in it; null where none does."""
    name = table.column("slice").to_pylist()
    hs = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("many").to_pylist(), hs, strict=True)]
    all_h, n = np.unique(np.concatenate([*hs, *(h[m] for h, m in zip(hs, many, strict=True))]) if hs else np.zeros(0, np.uint64), return_counts=True)
    all_h = all_h[n > 1]
    out_name, out = [], []
    for s, h in zip(name, hs, strict=True):
        got = h[np.isin(h, all_h, assume_unique=True)]
        if len(got):
            out_name.append(s)
            out.append(got.tobytes())
    return pa.table({"slice": pa.array(out_name, pa.int64()), "again": pa.array(out, pa.binary())})


def _starts(batches):
    """Rows (d, t, starts): the start words of the repeated windows of each document."""
    for batch in batches:
        out_d, out_t, out = [], [], []
        col = {k: batch.column(k) for k in batch.schema.names}
        for r in range(batch.num_rows):
            h, row, word, d, t = (np.frombuffer(col[k][r].as_py(), kind) for k, kind in (("h", np.uint64), ("row", np.uint32), ("word", np.uint32), ("d", np.int64), ("t", np.int32)))
            again = np.sort(np.frombuffer(b"".join(col["again"][r].as_py()), np.uint64))
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            hit = again[at] == h
            row, word = row[hit], word[hit]
            edges = np.flatnonzero(np.diff(row.astype(np.int64), prepend=-1, append=len(d)))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                out_d.append(int(d[row[i]]))
                out_t.append(int(t[row[i]]))
                out.append(word[i:j].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_t, pa.int32()), pa.array(out, pa.binary())], names=["d", "t", "starts"])


def _cover(window: int, with_text: bool):
    """Rows of the result from (doc_id, text, starts of repeated windows)."""

    def run(batches):
        for batch in batches:
            ids, starts = batch.column("doc_id"), batch.column("starts")
            n_words, n_removed, sha, kept_text = [], [], [], []
            for a, b, w in slices(batch.column("text")):
                for r in range(a, b):
                    i, j = int(w.first[r - a]), int(w.first[r - a + 1])
                    s = starts[r].as_py()
                    raw = w.data[w.offsets[r - a] : w.offsets[r - a + 1]].tobytes()
                    words = raw.split()
                    gone = 0
                    if s:
                        mark = np.zeros(j - i + 1, np.int32)
                        at = np.frombuffer(s, np.uint32).astype(np.int64)
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + window, -1)
                        keep = np.cumsum(mark)[: j - i] == 0
                        gone = int((~keep).sum())
                        words = [words[k] for k in np.flatnonzero(keep)]
                    kept = b" ".join(words)
                    n_words.append(j - i)
                    n_removed.append(gone)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """(d, t, starts): for each document with a repeat, the packed start words of all its windows whose word sequence occurs elsewhere; d and t are ``row_key()``."""
    block = (window + 1) // 2
    _, size = text_bytes(docs)
    buckets = max(24, size // BUCKET_TEXT_BYTES)
    keyed = docs.select(*row_key(), "text")
    sent = docs.select("text").mapInArrow(_send(buckets, block), "b int, single binary, many binary, blocks binary")
    anchors = sent.groupBy("b").applyInArrow(_meet, "key long")
    held = keyed.mapInArrow(_anchors(buckets, block), "key long, d long, t int, word int")
    hits = materialize(held.join(anchors, "key", "left_semi").select("d", "t", "word"), "anchors")
    release(docs.sparkSession)
    at = hits.groupBy("d", "t").agg(F.collect_set("word").alias("words"))
    packed = "slice long, h binary, row binary, word binary, d binary, t binary"
    near = materialize(keyed.join(at, ["d", "t"]).select("d", "t", "text", "words").mapInArrow(_near(window, block), packed), "near")
    release(docs.sparkSession)
    again = near.select("slice", "h").mapInArrow(_count(buckets), "b int, slice long, h binary, many binary").groupBy("b").applyInArrow(_again, "slice long, again binary")
    again = again.groupBy("slice").agg(F.collect_list("again").alias("again"))
    starts = materialize(near.join(again, "slice").mapInArrow(_starts, "d long, t int, starts binary"), "starts")
    release(docs.sparkSession)
    return starts.dropDuplicates(["d", "t"])  # rows that repeat in full have the same starts


def dedup_substrings(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless ``with_text``) of every row of ``docs`` (doc_id, text)."""
    starts = repeated_windows(docs, window)
    joined = docs.select("doc_id", *row_key(), "text").join(starts, ["d", "t"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cover(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
