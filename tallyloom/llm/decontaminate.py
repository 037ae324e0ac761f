"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 7).

Texts become sequences of lower-case alphanumeric words. A document leaks an item when
one of its windows is within ``max_edits`` (a share of the item's words) insertions,
deletions and replacements of the item.

The CGK random walk maps a sequence to a string of fixed length: step j emits the
current word and moves on if a hash of (j, word) says so, so sequences within a few
edits agree in most places. Each of ``TABLES`` tables samples ``SAMPLES`` places of one
of ``WALKS`` walks; windows and items that agree on a table's sample are candidates,
and an exact edit distance decides. With 40 tables of 3 samples, a pair that agrees in
half of the places of its walk is missed with probability (7/8)^40, under 1 in 200.

Windows have the item's own length, at every word of every document, and run past
both ends of a document by as many words as edits can take away; a missing word counts
as the word 0. Each edit spoils q word q-grams at most, so a window of n words within e
edits of an item holds n + 1 - q - q e of them that occur in the benchmark; windows with
fewer (q = 2, 3 or 4) are not embedded, and nothing is lost by that: words that are missing
at an end are edits of the item themselves, so the bound holds there as it is. Bitmaps of fixed size (the benchmark's runs
of two, three and four words, table keys and lengths) let each task drop what cannot match. Executors build them page by page, so the driver
gathers a few megabytes whatever the benchmark holds; a large benchmark fills them up and costs time, not results.

Items of fewer than ``MIN_WORDS`` words are matched exactly, by their whole word sequence.

Items are a stated query set; documents are never compared with each other. Candidate
regions carry their own words, so no text is shuffled. Nulls: a null or
empty text holds no window, a null or empty item no words, and neither is ever
reported; null ids are kept. Very long texts are scanned whole. Equal rows are reported alike; repeated items are reported
by each id; of several places of an item the one with fewest edits is reported, of ties the first. Other columns are ignored by ``report`` and
kept by ``clean``, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import FILTER_BITS, bitmaps, holds, materialize, row_key
from .textscan import ALNUM, LOWER, mix, slices

WALKS, TABLES, SAMPLES = 8, 40, 3
MAX_EDITS = 0.2
#: Items of fewer words are too short for edits and are matched exactly.
MIN_WORDS = 8
#: Words of the q-grams whose bitmaps tell windows that cannot be within the edits; the key's bitmap is kind 1.
GRAMS = (2, 3, 4)
#: Slices whose windows are embedded together, and windows at a time.
TOGETHER, WINDOWS = 16, 10_000
_C = np.uint64(0x9E3779B97F4A7C15)


def embed(hashes: np.ndarray, at: np.ndarray, n: int, walk: int, places: np.ndarray) -> np.ndarray:
    """What the walk emits at ``places`` (ascending) for the windows of ``n`` words at ``at``: array (windows, places); 0 past the end."""
    steps = int(places[-1]) + 1
    # bit j of a word's coins says whether step j moves on from it
    with np.errstate(over="ignore"):
        coins = [mix(hashes ^ (_C * np.uint64(walk * 1009 + k + 1))) for k in range(-(-steps // 64))]
    p, end = at.copy(), at + n
    out = np.zeros((len(places), len(at)), np.uint64)
    want = {int(x): k for k, x in enumerate(places)}
    for j in range(steps):
        q = np.minimum(p, len(hashes) - 1)
        if j in want:
            out[want[j]] = np.where(p < end, hashes[q], np.uint64(0))
        p += ((coins[j >> 6][q] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        np.minimum(p, end, out=p)
    return out.T


@functools.lru_cache(maxsize=None)
def _plan(n: int) -> list[tuple[int, np.ndarray]]:
    """(walk, places) of each table for windows of n words; from a seed, so that both sides draw the same."""
    rng = np.random.RandomState(1000 + n)
    # the walk moves at every other step, so two n steps pass the whole window
    return [(t % WALKS, np.sort(rng.choice(2 * n - 2, SAMPLES, replace=False))) for t in range(TABLES)]


def _keys(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(windows, TABLES) keys of the windows of n words at ``at``."""
    plan = _plan(n)
    # only the words that some window holds
    mark = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    held = np.cumsum(mark)[:-1] > 0
    at, hashes = (np.cumsum(held) - held)[at], hashes[held]
    out = np.empty((len(at), TABLES), np.uint64)
    with np.errstate(over="ignore"):
        for walk in range(WALKS):
            mine = [t for t, (w, _) in enumerate(plan) if w == walk]
            places = np.unique(np.concatenate([plan[t][1] for t in mine]))
            got = embed(hashes, at, n, walk, places)
            for t in mine:
                k = np.full(len(at), np.uint64(n * TABLES + t), np.uint64)
                for p in plan[t][1]:
                    k = mix(k * _C + got[:, np.searchsorted(places, p)])
                out[:, t] = k
    return out


def _exact_keys(sequences: np.ndarray, n: int) -> np.ndarray:
    """Keys of whole sequences of n words (their hashes), for items of fewer than MIN_WORDS words."""
    with np.errstate(over="ignore"):
        return mix(sequences ^ _C * np.uint64(n))


def _item_keys(w, whole: np.ndarray, r: int) -> np.ndarray:
    """The keys of item r of ``w``, one for each table, or one of all its words (``whole``: their hash) where they are few; none without words."""
    a, b = w.first[r], w.first[r + 1]
    if b - a >= MIN_WORDS:
        return _keys(w.hash[a:b], np.zeros(1, np.int64), int(b - a))[0]
    return _exact_keys(whole[r : r + 1], b - a) if b > a else np.zeros(0, np.uint64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words inserted, deleted or replaced to turn a into b; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i + 1], new])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1
    return int(row[-1])


def best_window(text: np.ndarray, item: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edit distance of the item to any run of words of ``text``, and the run's bounds."""
    m = len(text)
    row, steps = np.zeros(m + 1, np.int64), np.arange(m + 1)
    back = [row]
    for i, x in enumerate(item):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (text != x))])
        row = np.minimum.accumulate(new - steps) + steps
        back.append(row)
        if row.min() > most:
            return most + 1, 0, 0
    stop = int(row.argmin())
    i, j = len(item), stop
    while i > 0:  # walk back to where the run starts
        if j > 0 and back[i][j] == back[i - 1][j - 1] + (text[j - 1] != item[i - 1]):
            i, j = i - 1, j - 1
        elif back[i][j] == back[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return int(row[stop]), j, stop


def _item_rows(batches):
    """(key, item_id): an item's key in each table."""
    for batch in batches:
        ids = batch.column("item_id")
        cols = {"key": [], "item_id": []}
        for a, b, w in slices(batch.column("text"), ALNUM, LOWER):
            whole = w.hash_of(w.first[:-1], w.first[1:])
            for r in range(a, b):
                keys = np.unique(_item_keys(w, whole, r - a).view(np.int64))
                cols["key"] += keys.tolist()
                cols["item_id"] += [ids[r].as_py()] * len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(cols["key"], pa.int64()), pa.array(cols["item_id"], pa.int64())], names=list(cols))


def _item_words(batches):
    """(item_id, item): the words of each item that has any."""
    for batch in batches:
        ids, words = [], []
        for a, b, w in slices(batch.column("text"), ALNUM, LOWER):
            for r in range(a, b):
                h = w.hash[w.first[r - a] : w.first[r - a + 1]]
                if len(h):
                    ids.append(batch.column("item_id")[r].as_py())
                    words.append(h.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], names=["item_id", "item"])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bitmap_slots(batches):
    """(kind, slot): places that the items take in the bitmaps of their lengths (0), keys (1) and runs of q words (q)."""
    for batch in batches:
        grams, keys, lengths = {q: [] for q in GRAMS}, [], set()
        for a, b, w in slices(batch.column("text"), ALNUM, LOWER):
            for q in grams:
                grams[q].append(_slot(w.windows(q)[1]))
            whole = w.hash_of(w.first[:-1], w.first[1:])
            for r in range(b - a):
                n = int(w.first[r + 1] - w.first[r])
                if n:
                    lengths.add(n)
                    keys.append(_slot(mix(_item_keys(w, whole, r))))
        for kind, x in ((0, [np.array(sorted(lengths), np.int64)]), (1, keys), *grams.items()):
            x = np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x, pa.int64())], names=["kind", "slot"])


def item_bitmaps(items: DataFrame) -> tuple[dict[int, bytes], list[int]]:
    """The bitmaps (by kind) of keys and runs of words of ``items`` (text), and the items' lengths."""
    maps = bitmaps(items.select("text").mapInArrow(_bitmap_slots, "kind int, slot long"), 1 + max(GRAMS))
    return maps, np.flatnonzero(np.unpackbits(np.frombuffer(maps.pop(0), np.uint8))).tolist()


def padded(w, lengths: list[int], max_edits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, place, begin, end): the words with zeros around every row, for windows that run past its ends, where each word stands, and each row's bounds. A row has as many zeros as the windows that it can hold may miss words."""
    most = np.array([int(max_edits * n) for n in lengths], np.int64)
    least = np.maximum.accumulate(np.array(lengths, np.int64) - most) if len(lengths) else most
    size = np.diff(w.first)
    need = np.append(0, np.maximum.accumulate(most) if len(lengths) else most)[np.searchsorted(least, size, "right")]
    shift = np.cumsum(np.maximum(need, np.append(0, need[:-1])))
    begin = w.first[:-1] + shift
    place = np.arange(len(w.hash)) + np.repeat(shift, size)
    hashes = np.zeros(int(begin[-1] + size[-1] + need[-1]), np.uint64)
    hashes[place] = w.hash
    return hashes, place, begin, begin + size


def _inside(at: np.ndarray, n: int, most: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the windows hold all but ``most`` of their n words in one row."""
    row = np.minimum(np.searchsorted(end, at, "right"), len(end) - 1)
    return np.minimum(end[row], at + n) - np.maximum(begin[row], at) >= n - most


def _keyed(waiting: list, n: int):
    """(a, hashes, begin, end, at, keys) of the windows of n words that wait in each slice, in parts of ``WINDOWS``."""
    held, size = [], 0
    for a, hashes, begin, end, found in waiting:
        for at in np.array_split(found[n], -(-len(found[n]) // WINDOWS)) if n in found else ():
            held.append((a, hashes, begin, end, at))
            size += len(at)
            if size >= WINDOWS:
                yield from _together(held, n)
                held, size = [], 0
    if held:
        yield from _together(held, n)


def _together(held: list, n: int):
    words = np.concatenate([hashes[at[:, None] + np.arange(n)] for _, hashes, _, _, at in held])
    k = _keys(words.ravel(), np.arange(len(words)) * n, n)
    upto = np.cumsum([len(x[4]) for x in held])
    for x, part in zip(held, np.split(k, upto[:-1]), strict=True):
        yield *x, part


def _regions(maps: dict[int, bytes], lengths: list[int], max_edits: float):
    """(d, t, first, words, keys): runs of windows that share a key with an item, with as many words more on either side as edits can add."""

    short, lengths = [n for n in lengths if n < MIN_WORDS], [n for n in lengths if n >= MIN_WORDS]

    def embedded(waiting: list, d: np.ndarray, t: np.ndarray, out: dict) -> None:
        """Regions of the windows that share a key with an item. Windows of one length are embedded together, whatever slice they are from: a walk has hundreds of steps, each a few calls."""
        for n in lengths:
            most = int(max_edits * n)
            for a, hashes, begin, end, at, k in _keyed(waiting, n):
                hit = holds(maps[1], _slot(mix(k)))
                some = hit.any(axis=1)
                at, k, hit = at[some], k[some], hit[some]
                if not len(at):
                    continue
                row = np.searchsorted(end, at, "right")
                edges = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-n - 1) > n))
                for i, j in zip(edges, np.append(edges[1:], len(at)), strict=True):
                    lo, hi = max(at[i] - most, begin[row[i]]), min(at[j - 1] + n + most, end[row[i]])
                    out["d"].append(int(d[a + row[i]]))
                    out["t"].append(int(t[a + row[i]]))
                    out["first"].append(int(lo - begin[row[i]]))
                    out["words"].append(hashes[lo:hi].tobytes())
                    out["keys"].append(np.unique(k[i:j][hit[i:j]].view(np.int64)))

    def run(batches):
        for batch in batches:
            d, t = batch.column("d").to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False)
            out = {k: [] for k in ("d", "t", "first", "words", "keys")}
            waiting = []
            for a, _, w in slices(batch.column("text"), ALNUM, LOWER):
                hashes, place, begin, end = padded(w, lengths, max_edits)
                good = {}
                for q in GRAMS:  # q-grams of the benchmark that start before each place
                    start, h = w.windows(q)
                    known = np.zeros(len(hashes) + 1, np.int32)
                    known[place[start] + 1] = holds(maps[q], _slot(h))
                    good[q] = np.cumsum(known)
                for n in short:
                    at, h = w.windows(n)
                    k = _exact_keys(h, n)
                    hit = holds(maps[1], _slot(mix(k)))
                    at, k = at[hit], k[hit]
                    # the first place of a sequence in each row is enough
                    _, once = np.unique(np.stack([w.doc[at], k.view(np.int64)]), axis=1, return_index=True)
                    for i in once:
                        row = w.doc[at[i]]
                        out["d"].append(int(d[a + row]))
                        out["t"].append(int(t[a + row]))
                        out["first"].append(int(at[i] - w.first[row]))
                        out["words"].append(w.hash[at[i] : at[i] + n].tobytes())
                        out["keys"].append(k[i : i + 1].view(np.int64))
                found = {}
                for n in lengths:
                    most = int(max_edits * n)
                    last = len(hashes) - n
                    if last < 0:
                        continue
                    at = np.flatnonzero(good[2][n - 1 : n + last] - good[2][: last + 1] >= max(1, n - 1 - 2 * most))
                    for q in GRAMS[1:]:
                        at = at[good[q][at + n + 1 - q] - good[q][at] >= n + 1 - q - q * most]
                    at = at[_inside(at, n, most, begin, end)]
                    if len(at):
                        found[n] = at
                waiting.append((a, hashes, begin, end, found))
                if len(waiting) == TOGETHER:
                    embedded(waiting, d, t, out)
                    waiting = []
            embedded(waiting, d, t, out)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _verify(max_edits: float):
    """Keeps candidates within the bound: (d, t, item_id, edits, n_item, first, last), words from 0, last inclusive."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("d", "t", "item_id", "edits", "n_item", "first", "last")}
            col = {k: batch.column(k) for k in batch.schema.names}
            for r in range(batch.num_rows):
                item = np.frombuffer(col["item"][r].as_py(), np.uint64)
                text = np.frombuffer(col["words"][r].as_py(), np.uint64)
                most = int(max_edits * len(item)) if len(item) >= MIN_WORDS else 0
                edits, i, j = best_window(text, item, most)
                if edits <= most:
                    first = col["first"][r].as_py()
                    for k, v in zip(out, (col["d"][r].as_py(), col["t"][r].as_py(), col["item_id"][r].as_py(), edits, len(item), first + i, first + j - 1), strict=True):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """(d, t, item_id, edits, n_item, first, last): the closest place of each item in each document that holds it; d and t are ``row_key()``."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    maps, lengths = item_bitmaps(items)
    keyed = docs.select(*row_key(), "text")
    regions = keyed.mapInArrow(_regions(maps, lengths, max_edits), "d long, t int, first long, words binary, keys array<long>")
    regions = materialize(regions, "regions").dropDuplicates()
    index = items.mapInArrow(_item_rows, "key long, item_id long").distinct()
    pairs = regions.select("d", "t", "first", F.explode("keys").alias("key")).join(index, "key").select("d", "t", "first", "item_id").distinct()
    words = items.mapInArrow(_item_words, "item_id long, item binary").distinct()
    near = regions.select("d", "t", "first", "words").join(pairs, ["d", "t", "first"]).join(words, "item_id")
    found = near.select("d", "t", "item_id", "item", "first", "words").mapInArrow(_verify(max_edits), "d long, t int, item_id long, edits int, n_item int, first long, last long")
    best = found.groupBy("d", "t", "item_id").agg(F.min(F.struct("edits", "first", "last", "n_item")).alias("x"))
    return best.select("d", "t", "item_id", "x.edits", "x.n_item", "x.first", "x.last")


def report(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """doc_id, item_id, edits, n_item, first_word, last_word: a row for each document and item that it leaks."""
    found = leaks(docs, items, max_edits)
    out = docs.select("doc_id", *row_key()).join(found, ["d", "t"])
    return out.select("doc_id", "item_id", "edits", "n_item", F.col("first").alias("first_word"), F.col("last").alias("last_word"))


def clean(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    found = leaks(docs, items, max_edits).select("d", "t").distinct()
    # the caller's row as one column, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    return rows.join(found, ["d", "t"], "left_anti").select("row.*")
