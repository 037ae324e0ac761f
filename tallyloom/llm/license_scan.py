"""License scans by diagonal voting (operator 2), DataFrame functions only.

Every rolling three-word hash of every text joins the positions of the templates'
hashes; a hit counts when its three words agree one by one. A hit at word p of template place q votes for the diagonal p - q. Votes are
aggregated by text, template and diagonal, and neighbouring diagonals
(an inserted or missing word moves the rest of a template onto the next ones) merge
into spans. A span is verified: enough of the template's places voted, and all words that tell the
template from a similar one of another label stand in the text.

One pass reads the texts; it writes a row for each document and each hit, and all that
follows reads those. Templates may be of any length (a phrase or a whole license text). They are a list given by
the caller and broadcast while they have ``BROADCAST_PLACES`` words or fewer; a longer list is joined like any other table.

Nulls: a null text is empty; a null doc_id is kept. Very long texts are scanned whole. Equal rows get equal rows, each by itself, so
copies meet in no task. Ties: all labels whose spans are verified are named. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialize

K = 3
#: Diagonals at most so far apart merge.
DRIFT = 2
#: Of a template's places, those that vote at least.
MIN_SHARE = 0.6
#: Templates that share this part of their words, but not the label, are told apart by the others.
ALIKE = 0.75
BROADCAST_PLACES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose exact places are counted, with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Wordings of well-known licenses, with their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
]


def words_of(text: str) -> str:
    return rf"array_remove(split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), '')"


def _grams(words: str) -> str:
    return f"CASE WHEN size({words}) >= {K} THEN transform(slice({words}, 1, size({words}) - {K - 1}), (x, i) -> xxhash64(x, {', '.join(f'get({words}, i + {j})' for j in range(1, K))})) END"


def telling(templates: list[tuple[str, str]]) -> list[list[int]]:
    """For each template the places of words that a similar template of another label lacks."""
    words = [t.split() for t, _ in templates]
    out = []
    for mine, (_, label) in zip(words, templates, strict=True):
        places = set()
        for other, (_, theirs) in zip(words, templates, strict=True):
            lacks = [i for i, w in enumerate(mine) if w not in set(other)]
            if label != theirs and len(mine) - len(lacks) >= ALIKE * len(mine):
                places |= set(lacks)
        out.append(sorted(places))
    return out


def template_table(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(tid, label, base, n, grams, telling) of each template, and (h, tid, place, w0, w1, w2) of each of its places."""
    rows = [(t, lab, True, []) for t, lab in base] + [(t, lab, False, x) for (t, lab), x in zip(templates, telling(templates), strict=True)]
    if any(len(t.split()) < K for t, *_ in rows):
        raise ValueError(f"templates have {K} words or more")
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {quote(t)}, {quote(lab)}, {str(b).lower()}, cast(array({', '.join(map(str, x))}) as array<int>))" for i, (t, lab, b, x) in enumerate(rows))
    t = spark.sql(f"SELECT tid, split(t, ' ') AS twords, label, base, telling FROM VALUES {values} AS v(tid, t, label, base, telling)")
    t = t.withColumn("g", F.expr(_grams("twords")))
    places = t.select("tid", "twords", F.posexplode("g").alias("place", "h")).select("h", "tid", "place", *(F.expr(f"get(twords, place + {j})").alias(f"w{j}") for j in range(K)))
    if sum(len(t.split()) for t, *_ in rows) <= BROADCAST_PLACES:
        places = F.broadcast(places)
    return t.select("tid", "label", "base", F.size("twords").alias("n"), F.size("g").alias("grams"), "telling"), places


def hits(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, at, tid, place): a row with ``at`` 0 for each document, and one for each hit, its first word being ``at`` - 1."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.expr(words_of("text")).alias("words"))
    d = d.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.posexplode(F.expr(f"concat(array(cast(null as bigint)), coalesce({_grams('words')}, cast(array() as array<bigint>)))")).alias("at", "h"))
    same = " AND ".join(f"get(words, at - 1 + {j}) = w{j}" for j in range(K))
    d = d.join(places, "h", "left").where(F.expr(f"at = 0 OR (tid IS NOT NULL AND {same})"))
    return d.select("rid", "doc_id", "n_words", "at", "tid", "place")


def spans(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(rid, label, base, start, score): verified spans; ``start`` in words from 0."""
    templates = F.broadcast(templates)  # a row for each template of the caller's list
    v = found.where("tid IS NOT NULL").groupBy("rid", "tid", (F.col("at") - 1 - F.col("place")).alias("diag")).agg(F.collect_list("place").alias("places")).join(templates, "tid")
    exact = v.where(F.col("base") & (F.size("places") == F.col("grams"))).select("rid", "label", "base", F.col("diag").cast("long").alias("start"), F.lit(1.0).alias("score"))
    w = Window.partitionBy("rid", "tid").orderBy("diag")
    v = v.where(~F.col("base")).withColumn("new", (F.col("diag") - F.coalesce(F.lag("diag").over(w), F.col("diag") - DRIFT - 1) > DRIFT).cast("int"))
    v = v.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    s = v.groupBy("rid", "tid", "label", "base", "n", "grams", "telling", "island").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("diag").alias("diag"))
    s = s.withColumn("agreed", F.expr(f"array_distinct(flatten(transform(places, q -> sequence(q, q + {K - 1}))))"))
    s = s.where(F.expr(f"size(places) >= {MIN_SHARE} * grams AND size(array_except(telling, agreed)) = 0"))
    near = s.select("rid", "label", "base", F.expr("cast(greatest(diag + array_min(places), 0) as bigint)").alias("start"), (F.size("agreed") / F.col("n")).alias("score"))
    return exact.unionByName(near)


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs`` (doc_id, text)."""
    t, places = template_table(docs.sparkSession, base, templates)
    every = materialize(hits(docs.select("doc_id", "text"), places), "license")
    on_base = F.col("base")
    found = spans(every, t).groupBy("rid").agg(
        F.count_if(on_base).alias("n_base"),
        F.min(F.when(on_base, F.col("start"))).alias("first_word"),
        F.max(F.when(on_base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(on_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = every.where("at = 0").select("rid", "doc_id", "n_words").join(found, "rid", "left")
    return out.select("doc_id", "n_words", *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def oracle(base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL with the rows of ``scan``."""
    tell = [[] for _ in base] + telling(templates)
    values = ", ".join(f"({i}, '{t}', '{lab}', {i < len(base)}, {x}::INT[])" for i, ((t, lab), x) in enumerate(zip([*base, *templates], tell, strict=True)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT tid, string_split(t, ' ') AS tw, label, base, telling FROM (VALUES {values}) AS v(tid, t, label, base, telling)),
g AS (SELECT rid, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
tg AS (SELECT tid, i - 1 AS place, tw[i] || ' ' || tw[i + 1] || ' ' || tw[i + 2] AS h FROM (SELECT tid, tw, unnest(range(1, len(tw) - 1)) AS i FROM t)),
v AS (SELECT rid, tid, pos - place AS diag, list(place) AS places FROM g JOIN tg USING (h) GROUP BY ALL),
ex AS (SELECT rid, label, true AS base, diag AS start, 1.0::DOUBLE AS score FROM v JOIN t USING (tid) WHERE base AND len(places) = len(tw) - {K - 1}),
il AS (SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY diag ROWS UNBOUNDED PRECEDING) AS island
       FROM (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag) <= {DRIFT} THEN 0 ELSE 1 END AS new FROM v)),
pl AS (SELECT rid, tid, island, list_distinct(flatten(list(places))) AS places FROM il GROUP BY ALL),
ag AS (SELECT *, list_distinct(flatten(list_transform(places, lambda q: range(q, q + {K})))) AS agreed FROM pl),
nr AS (SELECT rid, label, false AS base, NULL::BIGINT AS start, len(agreed) / len(tw)::DOUBLE AS score FROM ag JOIN t USING (tid)
       WHERE NOT base AND len(places) >= {MIN_SHARE} * (len(tw) - {K - 1}) AND list_has_all(agreed, telling)),
f AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score
      FROM (SELECT * FROM ex UNION ALL SELECT * FROM nr) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid)
"""
