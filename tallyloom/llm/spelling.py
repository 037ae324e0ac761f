"""Spelling variants by full neighbourhood generation.

Every word emits all distinct strings that one deleted, replaced or inserted code point over the observed alphabet
makes of it; those that are words are its near words, found by a hash join of strings, so no distance is computed.
Candidates are first held as 64-bit hashes (sums over code points, so that a neighbour's hash is one addition) against
a Bloom filter of the vocabulary, which has no false negatives: only strings that pass it are built and shuffled. The
filter has about ``BITS_A_WORD`` bits a word and ``MAX_BITS`` (32 MB) at most; a larger vocabulary fills it up, which
costs shuffled rows, not results.

``words`` counts a corpus, ``group`` links a vocabulary. Null texts have no words and a null doc_id counts as an empty
one; ties of n go to the smallest word in code-point order; repeated rows count each; very long words are worked
through in slices; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bitmaps, drop, holds, materialize
from .textscan import mix

#: The letters of a word, and the capitals that are lowered.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BITS_A_WORD, MIN_BITS, MAX_BITS = 32, 18, 28
#: Candidates that a task holds together.
AT_ONCE = 1 << 20

with np.errstate(over="ignore"):
    _LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def words(docs: DataFrame, drop_one_in: int = 199) -> DataFrame:
    """(word, n): runs of letters with ASCII capitals lowered. Of a run whose crc32 with its doc_id ``drop_one_in`` divides, one code point is deleted."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    said = runs.withColumn("h", h).select(F.when(F.col("h") % drop_one_in == 0, less).otherwise(F.col("run")).alias("word"))
    return said.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Neighbours:
    """The distinct strings at one edit from each of some words of one length, as hashes, in slices of about ``AT_ONCE``."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        self.texts, self.alphabet, self.n = texts, alphabet, len(texts[0])
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), self.n)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n + 1, _BASE, np.uint64)]), dtype=np.uint64)
            terms = _LETTER[self.codes] * self.power[: self.n]
            self.before = np.concatenate([np.zeros((len(texts), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)

    def hashes(self) -> np.ndarray:
        return _named(self.before[:, -1], self.n)

    def _places(self, count: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, place) in slices whose candidates stay under ``AT_ONCE``."""
        step = max(1, AT_ONCE // max(1, width))
        for a in range(0, len(self.texts) * count, step):
            at = np.arange(a, min(a + step, len(self.texts) * count))
            yield at // count, at % count

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(hash, word, place, letter or 0, letters gone at the place) of every neighbour."""
        n, letters, total = self.n, self.alphabet, self.before[:, -1]
        with np.errstate(over="ignore"):
            for w, p in self._places(n, 1):
                last = (p + 1 == n) | (self.codes[w, np.minimum(p + 1, n - 1)] != self.codes[w, p])  # of a run of one letter, the last goes
                w, p = w[last], p[last]
                yield _named(self.before[w, p] + (total[w] - self.before[w, p + 1]) * _INVERSE, n - 1), w, p, np.zeros(len(w), np.uint32), 1
            for w, p in self._places(n, len(letters)):
                h = (self.before[w, p] + total[w] - self.before[w, p + 1])[:, None] + _LETTER[letters][None, :] * self.power[p][:, None]
                yield *_kept(_named(h, n), w, p, letters, self.codes[w, p]), 1
            for w, p in self._places(n + 1, len(letters)):
                h = (self.before[w, p] + (total[w] - self.before[w, p]) * np.uint64(_BASE))[:, None] + _LETTER[letters][None, :] * self.power[p][:, None]
                after = np.where(p < n, self.codes[w, np.minimum(p, n - 1)], 0)  # before its own kind a letter gives what it gives behind it
                yield *_kept(_named(h, n + 1), w, p, letters, after), 0

    def text(self, w: int, p: int, letter: int, gone: int) -> str:
        x = self.texts[w]
        return x[:p] + (chr(letter) if letter else "") + x[p + gone :]


def _named(h: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(length) * np.uint64(0xD6E8FEB86659FD93))


def _kept(h: np.ndarray, w: np.ndarray, p: np.ndarray, letters: np.ndarray, not_this: np.ndarray) -> tuple[np.ndarray, ...]:
    keep = letters[None, :] != not_this[:, None]
    n = len(letters)
    return h[keep], np.repeat(w, n)[keep.ravel()], np.repeat(p, n)[keep.ravel()], np.tile(letters, len(w))[keep.ravel()]


def _by_length(batch: pa.RecordBatch, alphabet: np.ndarray) -> Iterator[Neighbours]:
    texts: dict[int, list[str]] = {}
    for x in batch.column("word").to_pylist():
        texts.setdefault(len(x), []).append(x)
    for n, group in sorted(texts.items()):
        step = max(1, AT_ONCE // (n + 1))
        for a in range(0, len(group), step):
            yield Neighbours(group[a : a + step], alphabet)


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of a filter of 2^bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near): the pairs of words, both ways, that differ by exactly one inserted, deleted or replaced code point."""
    spark = vocabulary.sparkSession
    only = vocabulary.select("word")
    letters = [r[0] for r in only.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()]  # the alphabet: 90 at most
    if not letters:
        return only.select("word", F.col("word").alias("near")).limit(0)
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    bits = min(MAX_BITS, max(MIN_BITS, (BITS_A_WORD * only.count()).bit_length()))

    def occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _by_length(batch, alphabet):
                slot = np.concatenate(_slots(group.hashes(), bits))
                yield pa.RecordBatch.from_pydict({"kind": np.zeros(len(slot), np.int32), "slot": slot})

    taken = spark.sparkContext.broadcast(bitmaps(only.mapInArrow(occupied, "kind int, slot long"), 1, bits)[0])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _by_length(batch, alphabet):
                for h, w, p, letter, gone in group.slices():
                    first, second = _slots(h, bits)
                    at = np.flatnonzero(holds(taken.value, first))
                    at = at[holds(taken.value, second[at])]
                    if len(at):
                        found = [group.text(*x, gone) for x in zip(w[at].tolist(), p[at].tolist(), letter[at].tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({"word": [group.texts[i] for i in w[at].tolist()], "near": found})

    made = only.mapInArrow(candidates, "word string, near string")
    return made.join(only.select(F.col("word").alias("near")), "near", "left_semi")


def _nearest(struct: Column) -> Column:
    """Of structs (n, word) the one of largest n, then of the smallest word."""
    return F.min_by(struct, F.struct(-struct["n"], struct["word"]))


def group(counts: DataFrame, least_letters: int = 6, least_n: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``least_letters`` code points and ``least_n`` occurrences or more."""
    vocabulary = materialize(counts.where((F.length("word") >= least_letters) & (F.col("n") >= least_n)), "spelling-words")
    pairs = near_words(vocabulary)
    other = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(other, "near").select("word", F.struct(F.col("near_n").alias("n"), F.col("near").alias("word")).alias("other"))
    best = best.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _nearest(F.col("other")).alias("best"))
    formed = F.col("best.n") >= times * F.col("n")
    linked = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n"))
    linked = materialize(linked, "spelling-forms")
    rooted = _roots(linked)
    return linked.join(rooted, "word").select("word", "form", "root", "n", "n_near", "form_n")


def _roots(linked: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Each round doubles the way; n grows ``times``-fold a step, so a handful of rounds is enough for any corpus."""
    ways = linked.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNull().alias("ended"))
    held = None
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("ended").alias("next_ended"))
        moving = ways.where(~F.col("ended")).join(onward, "root").select("word", F.col("next").alias("root"), F.col("next_ended").alias("ended"))
        ways = materialize(ways.where("ended").unionByName(moving), "spelling-roots")
        if held is not None:
            drop(held)
        held = ways
        if ways.where(~F.col("ended")).isEmpty():
            return ways.select("word", "root")


#: Pairs by masks and deletions, without an alphabet; the checksum by its table.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents)
  GROUP BY doc_id, run),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c)::BIGINT >> 6), 128 + (ord(c)::BIGINT & 63)] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS h
  FROM bytes, crc),
v AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS other FROM places),
masked AS (SELECT word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
short AS (SELECT less.word, v.word AS near FROM less JOIN v ON less.other = v.word),
near AS (
  SELECT word, near FROM short
  UNION ALL SELECT near, word FROM short
  UNION ALL SELECT a.word, b.word FROM masked a JOIN masked b ON a.mask = b.mask AND a.i = b.i AND a.word <> b.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.near, struct_pack(a := -v.n, b := near.near)) AS form, max(v.n) AS form_n
  FROM near JOIN v ON near.near = v.word GROUP BY near.word),
linked AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word),
way AS (
  SELECT word, word AS at, form AS onward FROM linked
  UNION ALL SELECT way.word, l.word, l.form FROM way JOIN linked l ON way.onward = l.word)
SELECT l.word, l.form, way.at AS root, l.n, l.n_near, l.form_n FROM linked l JOIN way ON l.word = way.word AND way.onward IS NULL
"""
