"""Vectorised tokenising and hashing of whole Arrow text batches.

A batch is cut into slices of about ``SLICE_BYTES`` (one longer document makes a
slice of its own), so memory is bounded by the longest document. Words and their
64-bit hashes come from prefix sums over the UTF-8 bytes: no Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def _table(fn) -> np.ndarray:
    return np.array([fn(i) for i in range(256)], dtype=bool)


#: Bytes of words: everything but space and \x09-\x0D.
NON_SPACE = _table(lambda i: not (i == 32 or 9 <= i <= 13))
#: Bytes of alphanumeric words: digits, ASCII letters and every non-ASCII byte.
ALNUM = _table(lambda i: i > 127 or chr(i).isalnum())
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def _splitmix(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = np.array(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


_BYTE = _splitmix(256) | np.uint64(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                x = np.full(size, np.uint64(b), np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


_CHARS, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


class Words:
    """The words of consecutive documents. ``start``/``end``: byte offsets in ``data``; ``doc``: row of each word; ``first``: index of each row's first word (one more entry than rows); ``hash``: 64-bit hash of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray):
        n, rows = len(data), len(offsets) - 1
        self.data, self.offsets, self.rows = data, offsets, rows
        w = is_word[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:], after[:-1] = w[:-1], w[1:]
        self.start = np.flatnonzero(w & (~before | cut[:-1]))
        self.end = np.flatnonzero(w & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        up, down = _CHARS.to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[fold[data]] * up[:n], out=sums[1:])
        self._sums = sums
        self.hash = self.prefixes(n)

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of each word's first ``size`` bytes (of the whole word, where it is shorter)."""
        _, down = _CHARS.to(len(self.data) + 1)
        end = np.minimum(self.end, self.start + size)
        return mix((self._sums[end] - self._sums[self.start]) * down[self.start] + (end - self.start).astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of ``k`` words within one row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORDS.to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=sums[1:])
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, mix((sums[at + k] - sums[at]) * down[at])

    def hash_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a..b-1 (arrays of bounds)."""
        n = len(self.hash)
        up, down = _WORDS.to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=sums[1:])
        return mix((sums[b] - sums[a]) * down[a])


def slices(column: pa.Array, is_word: np.ndarray = NON_SPACE, fold: np.ndarray = SAME, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) over a text column; null texts have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(column))
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], is_word, fold)
        a = b


def word_hashes(words: list[str], fold: np.ndarray = SAME) -> np.ndarray:
    """Hashes of single words, as ``Words.hash`` has them."""
    out = [w.hash for _, _, w in slices(pa.array(words, pa.string()), _table(lambda i: True), fold)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
