"""Line-first quality rules (operator 8), DataFrame functions only.

Each line is judged by itself: symbol litter, shouting, one word over and over, a
navigation bar, a long line without punctuation, a boilerplate phrase (English, German, French, Spanish), a repeat of an earlier line. Lines that fail
are removed. A document is rejected when it fails a base rule (fewer than 50 words,
or over half of its words in repeated three-word windows) or when the removed lines
hold more than ``max_lost`` of its words.

Everything happens within the row: no shuffle, whatever the source or length.
Nulls: a null text has no words and so fails the base rule; a null doc_id is kept.
Very long texts are judged whole, in time n log n of their windows. Equal rows get equal verdicts, and of equal lines the first
stands. An empty table gives an empty result. ``judge`` replaces columns of the
input that share a name with one of ``DERIVED``; ``keep`` returns the input's columns
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]+"
#: Phrases of page furniture, in four languages.
PHRASES = [
    "all rights reserved",
    "accept (all )?cookies",
    "cookie policy",
    "privacy policy",
    "terms of (use|service)",
    "subscribe to our",
    "click here",
    "enable javascript",
    "sign up for",
    "alle rechte vorbehalten",
    "(alle )?cookies akzeptieren",
    "datenschutzerkl[äÄ]rung",
    "nutzungsbedingungen",
    "newsletter abonnieren",
    "hier klicken",
    "javascript aktivieren",
    "tous droits r[éÉ]serv[éÉ]s",
    "accepter (tous )?les cookies",
    "politique de confidentialit[éÉ]",
    "conditions d.utilisation",
    "abonnez-vous",
    "cliquez ici",
    "activer javascript",
    "todos los derechos reservados",
    "aceptar (todas )?las cookies",
    "pol[íÍ]tica de privacidad",
    "t[éÉ]rminos de uso",
    "suscr[íÍ]bete",
    "haga clic aqu[íÍ]",
    "activar javascript",
]
BOILERPLATE = f"(?i)({'|'.join(PHRASES)})"
#: A sentence's mark, and one at a line's end (quotes and brackets may follow it).
MARK = "[.!?:;…。！？]"
ENDS = MARK + "[\"')»”\\]]*[ \\r\\t]*$"
#: (rule, condition on a line's facts), in the order in which they are tried.
LINE_RULES = [
    ("symbols", "f.symbols >= 2 AND 10 * f.symbols > 3 * f.n"),
    ("shouting", "f.shouts >= 2 AND 10 * f.shouts > 3 * f.n"),
    ("one_word", "f.n >= 10 AND 10 * f.n_distinct < 3 * f.n"),
    ("navigation", "f.bars >= 2 AND 4 * f.bars >= f.n"),
    ("punctuation", "f.n >= 8 AND NOT f.ends AND 40 * f.marks < f.n"),
    ("boilerplate", "f.n <= 30 AND f.boilerplate"),
    ("repeat", "get(facts, j - 1).line = f.line"),
]
DERIVED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words", "line_rules", "clean_text"]


def _words(text: str) -> str:
    return f"array_remove(split({text}, '{SPACE}'), '')"


def _quoted(p: str) -> str:
    return "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _judged(docs: DataFrame, max_lost: float) -> DataFrame:
    """(row, verdict): each row of ``docs`` as a struct, so that no name can clash, and a struct of ``DERIVED``."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.expr("coalesce(text, '')").alias("text"))
    d = d.withColumn("words", F.expr(_words("text"))).withColumn("lines", F.expr(r"split(text, '\n')"))
    # (hash, index) of each three-word window in order of hash: equal windows are neighbours
    d = d.withColumn(
        "sorted",
        F.expr(
            """CASE WHEN size(words) >= 3 THEN sort_array(transform(slice(words, 1, size(words) - 2),
                 (x, i) -> struct(xxhash64(x, get(words, i + 1), get(words, i + 2)) AS h, i AS i))) END"""
        ),
    )
    d = d.withColumn("starts", F.expr("transform(filter(sorted, (x, j) -> x.h = get(sorted, j + 1).h OR x.h = get(sorted, j - 1).h), x -> x.i)"))
    d = d.withColumn("full", F.expr(r"filter(lines, l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn(
        "facts",
        F.expr(
            f"""transform(lines, l -> named_struct('line', l,
                  'words', {_words("l")},
                  'symbols', regexp_count(l, '[#*$%&|<>]+'), 'shouts', regexp_count(l, '!!+'), 'bars', regexp_count(l, '[|]'),
                  'ends', l rlike {_quoted(ENDS)}, 'marks', regexp_count(l, '{MARK}'),
                  'boilerplate', l rlike {_quoted(BOILERPLATE)}))"""
        ),
    )
    # In order of (line, place), so that a repeat stands after the line that it repeats; then in order of place again.
    d = d.withColumn(
        "facts",
        F.expr(
            """sort_array(transform(facts, (f, k) -> named_struct('line', f.line, 'k', k, 'n', size(f.words), 'n_distinct', size(array_distinct(f.words)),
                 'symbols', f.symbols, 'shouts', f.shouts, 'bars', f.bars, 'ends', f.ends, 'marks', f.marks, 'boilerplate', f.boilerplate)))"""
        ),
    )
    rules = "CASE WHEN f.n = 0 THEN NULL " + " ".join(f"WHEN {c} THEN '{name}'" for name, c in LINE_RULES) + " END"
    d = d.withColumn("judged", F.expr(f"sort_array(transform(facts, (f, j) -> named_struct('k', f.k, 'n', f.n, 'rule', {rules})))"))
    d = d.withColumn("line_rules", F.expr("transform(judged, x -> x.rule)"))
    d = d.withColumn("n_lost_words", F.expr("cast(aggregate(judged, 0, (a, x) -> a + IF(x.rule IS NULL, 0, x.n)) as bigint)"))
    d = d.select(
        "row",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(words, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(full) - size(array_distinct(full)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(coalesce(size(array_distinct(concat(starts, transform(starts, i -> i + 1), transform(starts, i -> i + 2)))), 0) as bigint)").alias("n_repeat_words"),
        "n_lost_words",
        "line_rules",
        F.expr("array_join(filter(lines, (l, k) -> get(line_rules, k) IS NULL), '\\n')").alias("clean_text"),
    )
    d = d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    d = d.withColumn("kept", F.expr(f"NOT base_failed AND n_lost_words <= {max_lost} * n_words"))
    # As a generator's output a verdict can be filtered on: a plain filter would be pushed down with all expressions above unfolded into it.
    return d.select("row", F.explode(F.array(F.struct(*DERIVED))).alias("verdict"))


def judge(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``kept``, ``n_lost_words``, ``line_rules`` (one rule name or null a line) and ``clean_text``."""
    own = [c for c in docs.columns if c not in DERIVED]
    return _judged(docs, max_lost).select(*(F.col(f"row.`{c}`") for c in own), "verdict.*")


def keep(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    return _judged(docs, max_lost).where("verdict.kept").select("row.*")


#: DuckDB SQL with the counts and the verdict of ``judge`` at its defaults.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
ln AS (SELECT rid, k, lines[k] AS line, list_position(lines, lines[k]) AS earliest,
              list_filter(regexp_split_to_array(lines[k], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
       FROM (SELECT rid, lines, unnest(range(1, len(lines) + 1)) AS k FROM d)),
lost AS (
  SELECT rid, sum(CASE WHEN bad THEN n ELSE 0 END) AS n, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup
  FROM (SELECT rid, line, n, n > 0 AND ((symbols >= 2 AND 10 * symbols > 3 * n) OR (shouts >= 2 AND 10 * shouts > 3 * n)
          OR (n >= 10 AND 10 * nd < 3 * n) OR (bars >= 2 AND 4 * bars >= n) OR (n >= 8 AND NOT ends AND 40 * marks < n) OR (n <= 30 AND boiler) OR earliest < k) AS bad
        FROM (SELECT rid, k, line, earliest, len(lw) AS n, len(list_distinct(lw)) AS nd,
                len(regexp_extract_all(line, '[#*$%&|<>]+')) AS symbols, len(regexp_extract_all(line, '!!+')) AS shouts,
                len(regexp_extract_all(line, '[|]')) AS bars, regexp_matches(line, '__ENDS__') AS ends, len(regexp_extract_all(line, '__MARK__')) AS marks, regexp_matches(line, '__BOILER__') AS boiler FROM ln))
  GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost <= 0.5 * n_words AS kept
FROM (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lost.dup, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost
      FROM d LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
""".replace("__BOILER__", BOILERPLATE).replace("__MARK__", MARK).replace("__ENDS__", ENDS.replace("'", "''"))
