"""Byte-level BPE: texts to token ids and back, by a rank file of the tiktoken library.

A text is cut where no match of the split pattern can cross, so that a text of any length is encoded stretch by
stretch with the ids of the whole: before white space that follows something else, and around runs of white space
too long for the pattern's lookahead (whose first n - 1 characters are one match by the pattern's own rules).
The rank file is read once, on the driver, and sent to the tasks (a megabyte or so; ``MAX_RANK_BYTES`` bounds it),
so executors need not hold the file.

``encode`` adds ``ids`` (array<int>) to a table, ``decode`` turns a column of ids into bytes; ``digest`` gives the
columns of the query. Null texts are empty and have no ids; null ids decode to no bytes; white space, control
characters and strings of special tokens are ordinary text; repeated rows are encoded each; an empty table gives an
empty result; every other column is kept, but for one of the new column's name, which is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of one call of the library, before the cut moves to a safe place.
STRETCH = 1 << 16
#: A longer run of white space is a match of its own (the library's matcher gives up at several hundred thousand).
LONG_SPACE = 1 << 12
#: Rows and ids of one batch that a task gives back.
BATCH_ROWS, BATCH_IDS = 512, 1 << 18
MAX_RANK_BYTES = 64 << 20

#: What \s means to the library's matcher (Unicode's White_Space), which is not what Python's re means.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
_LONG = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


class Codec:
    """The library's encodings for one rank file: by the split pattern, and of a match that is already known."""

    def __init__(self, ranks: bytes, pattern: str):
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=merges, special_tokens={})

    def stretches(self, text: str, start: int, end: int) -> Iterator[str]:
        """``text[start:end]`` in pieces of about ``STRETCH`` characters; ``end`` is itself a safe place."""
        while end - start > STRETCH:
            cut = _CUT.search(text, start + STRETCH, end)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        if start < end:
            yield text[start:end]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG_SPACE:
            return _ids(self.split, text)
        parts, start = [], 0
        for run in _LONG.finditer(text):
            a, b = run.span()
            parts += [_ids(self.split, piece) for piece in self.stretches(text, start, a)]
            start = b if b == len(text) else b - 1  # the last one of a run goes with what follows
            parts.append(_ids(self.whole, text[a:start]))
        parts += [_ids(self.split, piece) for piece in self.stretches(text, start, len(text))]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.split.decode_bytes(ids.tolist())


def _ids(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text in which no special token is known."""
    return encoding.encode_to_numpy(text, disallowed_special=())


_CODECS: dict[str, Codec] = {}


def _codec(key: str, ranks, pattern: str) -> Codec:
    """One codec a worker process, rank file and pattern."""
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def _replaced(rows: pa.RecordBatch, at: int, column: pa.Array, names: list[str]) -> pa.RecordBatch:
    """The batch, its columns so named, with one column in the place of column ``at`` (or appended)."""
    columns = list(rows.columns)
    columns[at : at + 1] = [column]
    return pa.RecordBatch.from_arrays(columns, names)


def _encode(batches: Iterator[pa.RecordBatch], source: int, at: int, names: list[str], key: str, ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(key, ranks, pattern)
    for batch in batches:
        texts, out, first, held = batch.column(source), [], 0, 0
        for i in range(batch.num_rows):
            out.append(codec.encode(texts[i].as_py() or ""))
            held += len(out[-1])
            if held >= BATCH_IDS or len(out) == BATCH_ROWS or i + 1 == batch.num_rows:
                ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).astype(np.int32)))
                yield _replaced(batch.slice(first, len(out)), at, lists, names)
                out, first, held = [], i + 1, 0


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row; none of a null."""
    ids, starts, sizes = lists.values.to_numpy(), lists.offsets.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=False):  # one offset more than rows
        yield ids[a : a + n]


def _decode(batches: Iterator[pa.RecordBatch], source: int, at: int, names: list[str], key: str, ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(key, ranks, pattern)
    for batch in batches:
        out, first, held = [], 0, 0
        for i, ids in enumerate(_rows(batch.column(source))):
            out.append(codec.decode(ids))
            held += len(out[-1])
            if held >= 4 * BATCH_IDS or len(out) == BATCH_ROWS or i + 1 == batch.num_rows:
                yield _replaced(batch.slice(first, len(out)), at, pa.array(out, pa.binary()), names)
                out, first, held = [], i + 1, 0


def _mapped(rows: DataFrame, f, source: str, into: str, kind: T.DataType, ranks_path: str, pattern: str) -> DataFrame:
    with open(ranks_path, "rb") as file:
        ranks = file.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{ranks_path}: rank files of more than {MAX_RANK_BYTES} bytes are not sent to tasks")
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    fields = list(rows.schema.fields)
    at = next((i for i, x in enumerate(fields) if x.name == into), len(fields))
    schema = T.StructType([*fields[:at], T.StructField(into, kind), *fields[at + 1 :]])
    sent = rows.sparkSession.sparkContext.broadcast(ranks)
    plain = rows.toDF(*(f"c{i}" for i in range(len(fields))))  # names with dots would not resolve
    return plain.mapInArrow(partial(f, source=rows.columns.index(source), at=at, names=schema.names, key=key, ranks=sent, pattern=pattern), schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    return _mapped(docs, _encode, text, into, T.ArrayType(T.IntegerType()), ranks_path, pattern)


def decode(rows: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that each row's ids stand for; they need not be valid UTF-8."""
    return _mapped(rows, _decode, ids, into, T.BinaryType(), ranks_path, pattern)


_DECIMAL: dict[int, pa.Array] = {}


@F.arrow_udf(T.StringType())
def _ids_sha256(lists: pa.Array) -> pa.Array:
    """Hash of the decimal ids joined by one space, fed in slices: a long text's ids are never one string."""
    out, top = [], 1 + (pc.max(lists.values).as_py() or 0)
    if top > len(_DECIMAL.get(0, ())):
        _DECIMAL[0] = pa.array([f" {i}" for i in range(max(top, 1 << 16))])
    for ids in _rows(lists):
        digest = hashlib.sha256()
        for a in range(0, len(ids), BATCH_IDS):
            said = _DECIMAL[0].take(pa.array(ids[a : a + BATCH_IDS]))  # its bytes lie one after the other
            digest.update(memoryview(said.buffers()[2])[not a : pc.sum(pc.binary_length(said)).as_py()])
        out.append(digest.hexdigest())
    return pa.array(out, pa.string())


def digest(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded again."""
    ids = encode(docs.select("doc_id", F.col("text").alias("ids")), ranks_path, pattern, text="ids")
    counted = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), _ids_sha256("ids").alias("ids_sha256"))
    decoded = decode(counted, ranks_path, pattern, into="ids")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("ids", 256).alias("decoded_sha256"))
