"""Hard negatives, spelling variants and byte-level BPE against plain versions, with the edge cases of their docstrings."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, hard_negatives, queries, spelling

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def codec():
    with open(RANKS, "rb") as file:
        return byte_bpe.Codec(file.read(), public_tokenizers.PATTERN)


def test_bpe_cuts_change_no_id(library, monkeypatch):
    """Cut every few characters, odd texts have the ids of the whole text."""
    monkeypatch.setattr(byte_bpe, "STRETCH", 7)
    monkeypatch.setattr(byte_bpe, "LONG_SPACE", 3)
    monkeypatch.setattr(byte_bpe, "_LONG", re.compile(f"[{byte_bpe.SPACE}]{{3,}}"))
    rng, own = random.Random(1), codec()
    letters = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0     　​᠎﻿ab1's!\xc9\xdf中\U0001f600’"
    for i in range(8000):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        if i % 2:
            x = re.sub("[ab1 ]", lambda m: m[0] * rng.randrange(9), x)
        assert own.encode(x).tolist() == library.encode_ordinary(x), x
        assert own.decode(own.encode(x)) == x.encode()


def test_bpe_of_long_texts(library):
    """Runs of white space on which the library gives up, and a text without a safe place."""
    own = codec()
    for x in ("a" * 200_000, "word " * 60_000, "x" + " " * 5000 + "y", "\n" * 5000, "　" * 4096 + "\U0001f600", " " * 4095 + "'s"):
        assert own.encode(x).tolist() == library.encode_ordinary(x)
    huge = " " * 1_500_000 + "end"
    ids = own.encode(huge)
    assert own.decode(ids) == huge.encode() and ids[-1:].tolist() == library.encode_ordinary(" end")


def test_bpe_table(spark, sf, library):
    """Null and empty texts, repeated rows, clashing columns, an empty table; the query over the whole table."""
    rows = [(1, "it's <|endoftext|> \U0001f600"), (2, None), (3, ""), (1, "it's <|endoftext|> \U0001f600"), (None, " \x00\xa0"), (4, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, 5, "keep") for r in rows], "doc_id long, text string, ids int, `a.b` string")
    encoded = byte_bpe.encode(docs, RANKS)
    assert encoded.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["ids"], r["a.b"]) for r in encoded.collect()), key=repr) == sorted(((i, t, library.encode_ordinary(t or ""), "keep") for i, t in rows), key=repr)
    decoded = byte_bpe.decode(encoded, RANKS)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in decoded.collect())
    nothing = spark.createDataFrame([(1, None), (2, [13])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(nothing, RANKS).orderBy("doc_id").collect()] == [b"", library.decode_bytes([13])]
    assert byte_bpe.digest(docs.limit(0), RANKS).count() == 0

    def plain(i, t):
        ids = library.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    for got, want in ((byte_bpe.digest(docs, RANKS), rows), (queries.op13_byte_bpe(spark, sf), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(*r) for r in want), key=repr)


def plain_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (place, vec_id, label, integer vector)."""
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for i, vid, label, v in rows:
        if vid is None or not is_anchor(vid):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), wid, j, other) for j, wid, other, w in rows if j != i and len(w) == len(v)]
        for s, pid, *_ in sorted((x for x in scored if x[3] == label), key=order)[:positives]:
            fits = sorted((x for x in scored if x[3] != label and low * s <= 100 * x[0] <= high * s), key=order)[:negatives]
            out += [(vid, pid, rank, nid, s, ns) for rank, (ns, nid, *_) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def integers(vec):
    return None if vec is None or any(x is None or not math.isfinite(x) or abs(x) >= 65536 for x in vec) else [math.floor(256 * x) for x in vec]


def test_hard_negatives(spark, monkeypatch):
    """Ties, repeated rows and ids, nulls, other lengths, large components; many small cells and blocks."""
    rng = np.random.RandomState(4)
    vecs = [(i, rng.randint(-3, 9, 6).astype(float).tolist(), int(rng.randint(3))) for i in range(240)]
    vecs += [(500 + i, vecs[0][1], i % 3) for i in range(60)]  # one vector very often
    vecs += [(7, vecs[7][1], vecs[7][2])] * 2 + [(None, vecs[3][1], 1), (900, None, 1), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 0), (903, [float("inf")] * 6, 0)]
    vecs += [(904, vecs[4][1], None), (910, [1.0, 2.0], 0), (920, [2.0, 1.0], 0), (930, [1.0, 1.0], 1), (940, [], 1), (950, [], 1), (960, [], 2), (970, [9000.5, -9000.25, 1.0, 1.0, 1.0, 1.0], 0), (971, [70000.0] * 6, 0)]
    table = spark.createDataFrame([(*v, 3) for v in vecs], "vec_id long, embedding array<double>, label int, rid int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    placed = hard_negatives.integer_rows(table, 256, label).collect()
    assert len(placed) == sum(integers(v) is not None and x is not None for _, v, x in vecs)
    want = plain_negatives([(r["rid"], r["vec_id"], r["label"], list(r["v"])) for r in placed], lambda i: i % 10 == 0)
    assert len(want) > 500
    for row_ints, anchor_ints, at_once in ((1 << 22, 1 << 19, 4096), (300, 40, 16)):
        for name, value in (("ROW_INTS", row_ints), ("ANCHOR_INTS", anchor_ints), ("ROWS_AT_ONCE", at_once), ("ANCHORS_AT_ONCE", 8)):
            monkeypatch.setattr(hard_negatives, name, value)
        got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, label)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0, label).count() == 0


def test_intervals_drop_pairs_before_the_last_plane():
    """Most pairs go while planes are left, and none that qualifies; large components are summed exactly."""
    rng = np.random.RandomState(5)
    for top, kind in ((120, np.float32), (1 << 15, np.float64), ((1 << 24) - 1, np.int64)):
        a, rows = rng.randint(-top, top, (6, 512)), rng.randint(-top, top, (900, 512))
        bits = 1 + int(top).bit_length()
        assert hard_negatives._number(a, bits) is kind or top == 120
        exact = a.astype(object) @ rows.T.astype(object)
        third = np.sort(exact, axis=1)[:, ::-1]
        high = third[:, 100].astype(np.int64)[:, None]
        low = third[:, 700].astype(np.int64)[:, None]
        x, y, score, left = hard_negatives.survivors(a, rows, np.ones((6, 900), bool), bits, low, high, np.full((6, 1), -(1 << 61), np.int64), 10)
        assert all(exact[i, j] == s for i, j, s in zip(x, y, score, strict=True))
        for i in range(6):
            assert set(third[i, 100:110]) <= set(score[x == i].tolist())
        assert left == sorted(left, reverse=True) and left[-1] < 0.05 * 5400 and min(left[:-1]) < 0.5 * 5400


def edits(word, alphabet):
    """All strings at one edit."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def plain_words(rows, one_in):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return n


def plain_groups(n, least_letters=6, least_n=5, times=5):
    n = {w: c for w, c in n.items() if len(w) >= least_letters and c >= least_n}
    alphabet = sorted(set("".join(n)))
    near = {w: edits(w, alphabet) & n.keys() for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=repr)


def test_neighbourhoods_are_whole_and_distinct(monkeypatch):
    """Every string at one edit once, in whatever slices, and its hash is that of the string."""
    monkeypatch.setattr(spelling, "AT_ONCE", 50)
    alphabet = np.array(sorted(map(ord, "ab\u00e9")), np.uint32)
    for group in (["aab\u00e9a", "bbbbb"], ["a"], ["ab" * 30]):
        own = spelling.Neighbours(group, alphabet)
        found = collections.defaultdict(list)
        for h, w, p, letter, gone in own.slices():
            for i, x in enumerate(zip(w.tolist(), p.tolist(), letter.tolist(), strict=True)):
                text = own.text(*x, gone)
                found[x[0]].append(text)
                assert not text or spelling.Neighbours([text], alphabet).hashes()[0] == h[i]
        for i, word in enumerate(group):
            assert len(found[i]) == len(set(found[i])) and set(found[i]) == edits(word, "ab\u00e9")


def test_spelling(spark):
    """Chains of forms, ties, capitals and accents, deleted letters, null ids and texts, repeated rows, a very long word."""
    long = "lo" * 3000
    texts = [("kitten " * 700, 1), ("kittan " * 120, 2), ("kittans Kittans " * 10, 3), ("kittanso " * 2, 4), ("sittan " * 6, 5), ("mittan " * 6, 5), ("\u00c9cole\u00e9s \u00c9colee\u00e9s " * 30, 6), (None, 7), ("", 8), ("abcdef abcdeg " * 5, None), (f"{long} {long}x " * 5, 9)]
    texts += [("w\u00d7rd x2y3 l'\u00e9t\u00e9s " * 8, 10)] * 3 + [(f"kittanso other{'abcdefgh'[i]}", 20 + i) for i in range(8)]
    docs = spark.createDataFrame([(i, t, 1, "x") for t, i in texts], "doc_id long, text string, n int, near string")
    for one_in in (199, 3):
        rows = [(i, t) for t, i in texts]
        got = spelling.group(spelling.words(docs, one_in)).collect()
        want = plain_groups(plain_words([r for r in rows if len(r[1] or "") < 20_000], one_in))
        assert sorted((tuple(r) for r in got if len(r["word"]) < 1000), key=repr) == want
        assert one_in < 199 or [r["n_near"] for r in got if len(r["word"]) > 1000] == [1, 1]
    chain = {"kitten": 9000, "kittan": 1000, "kittans": 100, "kittanso": 10, "kittansox": 10}
    got = spelling.group(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(chain) and {r["word"]: r["root"] for r in got}["kittanso"] == "kitten"
    assert spelling.group(spelling.words(docs.limit(0))).count() == 0
    assert spelling.group(spark.createDataFrame([("abcdef", 9)], "word string, n long")).collect()[0]["root"] == "abcdef"


def test_spelling_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op12_spelling(spark, sf).collect()), key=repr) == plain_groups(plain_words(rows, 199))
