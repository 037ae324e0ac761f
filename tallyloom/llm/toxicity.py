"""Toxicity by a linear-chain conditional random field (operator 1).

Training reads labelled documents only: at most ``MAX_LABELLED`` of them by hash, and
``MAX_BYTES`` of text (documented bounds), so it fits the driver whatever the corpus holds. Documents carry
labels, tokens do not; so tokens get labels first: a token of a toxic document whose
word or stem is far more frequent in toxic than in clean documents is toxic, every other token
is clean. A chain of two states (clean, toxic) is fitted to these tokens by gradient ascent on its penalised
log-likelihood, by forward-backward: marginals for the weights of features, pairwise
marginals for the transitions. A token's features are its word, two stems, its shape
(length, capital, digit, script) and the words before and after it, so tokens that no labelled document holds can be
tagged by their stem, shape and context. A small logistic layer over
each document's summed, largest and mean marginals is then fitted to the document
labels.

Scoring runs forward-backward over whole texts. The tokens of a slice of documents
form one chain that is cut at each document's start; products of 2 x 2 matrices over
lanes of the chain make it a vector computation, so a long text costs no more for each
token than a short one. Runs of tokens that are likelier toxic than not are the offending spans.

Nulls: a null text is empty; the empty text has a score too. A null doc_id is scored.
Very long texts are scored whole. Equal texts get equal scores; of rows that repeat a labelled doc_id, training reads the
least text, and of repeated labels the greatest. Other columns are ignored, whatever their names. An empty table gives an empty result; without labels, or
with labels of one kind only, every score is that kind's rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import ALNUM, LOWER, Words, mix, slices

BITS = 20
LANE = 64
#: Labelled documents that training reads at most, and bytes of their texts.
MAX_LABELLED, MAX_BYTES = 4_000, 1 << 26
#: Strength of the penalty on weights.
PENALTY = 0.5
_C = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """``keys`` (sorted hashes) and ``weights`` of features; ``trans``: log-potentials of toxic after (clean, toxic, start), against 0 for clean; ``doc``: bias and weights of the document layer."""

    keys: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    doc: np.ndarray
    hint: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        out = np.zeros(len(w.hash))
        for f in features(w):
            at, key = _known(self.keys, self.hint, f)
            out[at] += self.weights[key]
        return out


def stems(w: Words) -> list[np.ndarray]:
    """A token's word and its first 4 and 5 bytes (stems that inflect in other languages)."""
    with np.errstate(over="ignore"):
        return [w.hash, *(mix(w.prefixes(k) + _C * np.uint64(k)) for k in (4, 5))]


def features(w: Words) -> list[np.ndarray]:
    """``stems``, the token's shape, and the words before and after it in its document."""
    n = len(w.hash)
    start = _starts(w)
    stop = np.append(start[1:], True)[:n]
    head = w.data[w.start] if n else np.zeros(0, np.uint8)
    digits = np.append(0, np.cumsum((w.data >= 48) & (w.data <= 57)))
    wide = np.append(0, np.cumsum(w.data > 127))
    shape = np.minimum(w.end - w.start, 15) + 16 * ((head >= 65) & (head <= 90)) + 32 * (digits[w.end] > digits[w.start]) + 64 * (wide[w.end] > wide[w.start])
    before, after = np.roll(w.hash, 1), np.roll(w.hash, -1)
    with np.errstate(over="ignore"):
        context = [mix(np.where(edge, np.uint64(i), x) + _C * np.uint64(10 + i)) for i, (edge, x) in enumerate([(start, before), (stop, after)])]
        return [*stems(w), mix(shape.astype(np.uint64) + _C * np.uint64(20)), *context]


def _hint(keys: np.ndarray) -> np.ndarray:
    """A bitmap that most features outside the model miss."""
    bits = np.zeros(1 << BITS, bool)
    bits[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return bits


def _known(keys: np.ndarray, hint: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose feature is in the model, and its index there."""
    at = np.flatnonzero(hint[(f >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(keys):
        return at[:0], at[:0]
    i = np.minimum(np.searchsorted(keys, f[at]), len(keys) - 1)
    hit = keys[i] == f[at]
    return at[hit], i[hit]


def marginals(emit: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and P(toxic and the token before it toxic; 0 at a start). emit: log-odds of toxic; start: is it the first of its document."""
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros(0)
    lanes = -(-n // LANE)
    pad = lanes * LANE - n
    e = np.exp(np.clip(np.concatenate([emit, np.zeros(pad)]), -30, 30)).reshape(lanes, LANE)
    s = np.concatenate([start, np.ones(pad, bool)]).reshape(lanes, LANE)
    after = np.exp(trans)
    # step matrix from (clean, toxic) to (clean, toxic): [[1, a0 e], [1, a1 e]]; at a start both rows are [1, as e]
    m01 = np.where(s, after[2], after[0]) * e
    m11 = np.where(s, after[2], after[1]) * e
    whole = np.tile(np.eye(2), (lanes, 1, 1))
    for j in range(LANE):
        whole = np.stack([whole[:, :, 0] + whole[:, :, 1], whole[:, :, 0] * m01[:, j, None] + whole[:, :, 1] * m11[:, j, None]], axis=2)
        whole /= whole.max(axis=(1, 2), keepdims=True)
    # forward state entering each lane, and backward state leaving it
    enter, leave = np.empty((lanes, 2)), np.empty((lanes, 2))
    rows = whole.tolist()
    a0, a1 = 0.5, 0.5
    for i, ((p00, p01), (p10, p11)) in enumerate(rows):
        enter[i] = a0, a1
        a0, a1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    b0, b1 = 0.5, 0.5
    for i in range(lanes - 1, -1, -1):
        leave[i] = b0, b1
        (p00, p01), (p10, p11) = rows[i]
        b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    f = np.empty((lanes, LANE + 1, 2))
    x0, x1 = enter[:, 0], enter[:, 1]
    f[:, 0, 0], f[:, 0, 1] = x0, x1
    for j in range(LANE):
        x0, x1 = x0 + x1, x0 * m01[:, j] + x1 * m11[:, j]
        z = x0 + x1
        x0, x1 = x0 / z, x1 / z
        f[:, j + 1, 0], f[:, j + 1, 1] = x0, x1
    out, both = np.empty((lanes, LANE)), np.empty((lanes, LANE))
    y0, y1 = leave[:, 0], leave[:, 1]
    for j in range(LANE - 1, -1, -1):
        t, c = f[:, j + 1, 1] * y1, f[:, j + 1, 0] * y0
        out[:, j] = t / (t + c)
        # of the toxic mass here, the part that comes from a toxic token before
        from0, from1 = f[:, j, 0] * m01[:, j], f[:, j, 1] * m11[:, j]
        both[:, j] = out[:, j] * np.where(s[:, j], 0.0, from1 / (from0 + from1))
        y0, y1 = y0 + m01[:, j] * y1, y0 + m11[:, j] * y1
        z = y0 + y1
        y0, y1 = y0 / z, y1 / z
    return out.reshape(-1)[:n], both.reshape(-1)[:n]


def _starts(w: Words) -> np.ndarray:
    s = np.zeros(len(w.hash) + 1, bool)
    s[w.first] = True
    return s[:-1]


def _doc_features(w: Words, p: np.ndarray) -> np.ndarray:
    """(rows, 3): log(1 + summed marginals), largest marginal, square root of the mean marginal."""
    total = np.bincount(w.doc, p, w.rows)
    n = np.diff(w.first)
    top = np.zeros(w.rows)
    np.maximum.at(top, w.doc, p)
    return np.stack([np.log1p(total), top, np.sqrt(total / np.maximum(n, 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Bias and weights by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * np.r_[0.0, b[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _lexicon(parts: list[Words], y: np.ndarray, min_docs: int, min_ratio: float) -> np.ndarray:
    """Sorted features that mark toxic documents: ``min_docs`` of them, most of all that hold it, and a log-likelihood ratio of ``min_ratio`` or more."""
    seen, row = ([], []), 0
    for w in parts:
        feats = np.stack(stems(w), axis=1)
        for r in range(w.rows):
            seen[int(y[row + r])].append(np.unique(feats[w.first[r] : w.first[r + 1]]))
        row += w.rows
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    keys, k1 = np.unique(np.concatenate(seen[1]), return_counts=True)
    keys, k1 = keys[k1 >= min_docs], k1[k1 >= min_docs].astype(float)
    clean = np.sort(np.concatenate(seen[0]))
    k0 = (np.searchsorted(clean, keys, "right") - np.searchsorted(clean, keys)).astype(float)
    both, n = k0 + k1, n0 + n1
    term = lambda k, e: k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9))
    ratio = 2 * (term(k0, both * n0 / n) + term(k1, both * n1 / n) + term(n0 - k0, (n - both) * n0 / n) + term(n1 - k1, (n - both) * n1 / n))
    return keys[(ratio >= min_ratio) & (k1 > k0)]


@dataclass
class Chain:
    """Training tokens: ``key``s of the features that tokens ``at`` have, ``gold`` states and ``start``s of documents."""

    at: np.ndarray
    key: np.ndarray
    gold: np.ndarray
    start: np.ndarray


def gradient(chains: list[Chain], weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood in the weights and in the transitions, and its curvature in each by itself (an upper bound for the weights)."""
    g, h, gt, ht = np.zeros(len(weights)), np.zeros(len(weights)), np.zeros(3), np.zeros(3)
    for c in chains:
        emit = np.zeros(len(c.gold))
        np.add.at(emit, c.at, weights[c.key])
        p, both = marginals(emit, c.start, trans)
        g += np.bincount(c.key, (c.gold - p)[c.at], len(g))
        h += np.bincount(c.key, (p * (1 - p))[c.at], len(g))
        before = np.append(0.0, c.gold[:-1])[: len(c.gold)]
        # observed less expected: toxic after clean, toxic after toxic, toxic at a start
        kinds = [(~c.start * (1 - before) * c.gold, ~c.start * (p - both)), (~c.start * before * c.gold, both), (c.start * c.gold, c.start * p)]
        for i, (seen, expected) in enumerate(kinds):
            gt[i] += seen.sum() - expected.sum()
            ht[i] += (expected * (1 - expected)).sum()
    return g, gt, h, ht


def fit(texts: list[str | None], toxic: list[int], min_docs: int = 3, min_ratio: float = 18.0, rounds: int = 20) -> Model:
    """The chain and the document layer from labelled texts."""
    y = np.array(toxic, float)
    none = np.zeros(0, np.uint64)
    trans = np.array([-4.0, -2.0, -4.0])
    if not len(y) or y.min() == y.max():
        rate = y.mean() if len(y) else 0.0
        return Model(none, np.zeros(0), trans, np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0, 0.0]), _hint(none))
    parts = [w for _, _, w in slices(pa.array(texts, pa.string()), ALNUM, LOWER)]
    telling = _lexicon(parts, y, min_docs, min_ratio)
    hint, golds, row = _hint(telling), [], 0
    for w in parts:
        gold = np.zeros(len(w.hash))
        for f in stems(w):
            gold[_known(telling, hint, f)[0]] = 1.0
        golds.append(gold * y[row + w.doc])
        row += w.rows
    # the model's features: those that two toxic tokens or more have
    keys, count = np.unique(np.concatenate([f[gold > 0] for w, gold in zip(parts, golds, strict=True) for f in features(w)]), return_counts=True)
    keys = keys[count >= 2]
    hint, chains = _hint(keys), []
    for w, gold in zip(parts, golds, strict=True):
        at, key = (np.concatenate(x) for x in zip(*(_known(keys, hint, f) for f in features(w)), strict=True))
        chains.append(Chain(at, key, gold, _starts(w)))
    weights = np.zeros(len(keys))
    for _ in range(rounds):
        g, gt, h, ht = gradient(chains, weights, trans)
        # a token has six features, so each takes a part of the step that it would take alone
        weights = weights + np.clip((g - PENALTY * weights) / (3.0 * h + PENALTY + 1.0), -1.0, 1.0)
        trans = trans + np.clip(gt / (3.0 * ht + 2.0), -0.5, 0.5)
    model = Model(keys, weights, trans, np.zeros(4), hint)
    x = np.concatenate([_doc_features(w, marginals(model.emissions(w), _starts(w), model.trans)[0]) for w in parts])
    model.doc = _logistic(x, y)
    return model


def _runs(w: Words, p: np.ndarray) -> list[list[dict]]:
    """For each row the spans of toxic tokens: consecutive ones are one span, in code points from 0, end exclusive."""
    out = [[] for _ in range(w.rows)]
    hit = np.flatnonzero(p > 0.5)
    if len(hit):
        chars = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))
        cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(w.doc[hit]) > 0)) + 1
        for a, b in zip(hit[np.append(0, cut)], hit[np.append(cut - 1, len(hit) - 1)], strict=True):
            base = chars[w.offsets[w.doc[a]]]
            out[w.doc[a]].append({"start": int(chars[w.start[a]] - base), "stop": int(chars[w.end[b]] - base)})
    return out


def _score(model: Model):
    def run(batches):
        for batch in batches:
            score, at = np.zeros(batch.num_rows), []
            for a, b, w in slices(batch.column("text"), ALNUM, LOWER):
                p, _ = marginals(model.emissions(w), _starts(w), model.trans)
                z = _doc_features(w, p) @ model.doc[1:] + model.doc[0]
                score[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                at += _runs(w, p)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.3).astype(np.int32)), pa.array(at, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> list:
    """(doc_id, text, toxic) of at most ``max_labelled`` labelled documents outside the held-out fold and ``max_bytes`` of their texts, the same ones each time."""
    lab = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # bounded by max_labelled rows of two numbers
    first = F.broadcast(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.octet_length("text").alias("n")).join(first, "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))
    chosen, held = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r["n"], r["doc_id"])):
        if held + r["n"] > max_bytes:
            break
        held += r["n"]
        chosen.append((r["doc_id"], int(r["toxic"])))
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int"))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect())


def tag(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (code points of runs of toxic words) of every row of ``docs`` (doc_id, text)."""
    rows = training_rows(docs, labels, max_labelled)
    model = fit([t for _, t, _ in rows], [y for *_, y in rows])
    schema = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,stop:int>>"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_score(model), schema)
