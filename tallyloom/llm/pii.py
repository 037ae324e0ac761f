"""Personal data by weak supervision (operator 3), DataFrame functions only.

Base spans (email, ip, card, phone) come from strict patterns. Beyond them, looser
patterns propose candidates (credentials, spelled-out addresses, long numbers). Regex,
gazetteer and context labelers vote on each candidate: 1, 0 or abstain. Counts of the
vote patterns over all documents (a bounded table, whatever the corpus) go through
expectation-maximisation, which estimates each labeler's reliability; the posteriors
train a logistic span classifier over the votes and traits of the match itself (length, digits, letters among digits), whose weights become a column expression.

Matches within a row have their places from the lengths of what lies between them, so
nothing is shuffled but the vote counts. Patterns are possessive where they repeat and
anchored at the start of a run, so long runs cost linear time; running ends and overlaps come from
sorted matches and running sums and extremes, in blocks, so many matches in a text do too.
A loose match that overlaps a base span, or a loose match of an earlier kind, is dropped.

Nulls: a null text is empty; a null doc_id is kept. Very long texts are read whole. Equal rows give equal rows; ties in place go by the
order of kinds. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: (kind, pattern, text that any match holds). Runs of under 16 digits are no cards, so they aren't matched at all; the lookbehinds only skip starts that cannot begin a leftmost match.
BASE = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
]
#: (kind, pattern) of the candidates that labelers judge.
LOOSE = [
    ("secret", r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?[ ]{0,3}[:=][ ]{0,3}[\"']?[0-9A-Za-z+/_-]{6,}+"),
    ("contact", r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}+"),
    ("number", r"(?<![0-9A-Za-z.+-])[0-9](?:[ .-]?[0-9]){6,}+(?![0-9A-Za-z])"),
]
KINDS = [k for k, *_ in BASE] + [k for k, *_ in LOOSE]
#: Fixed values of the gazetteer and of the contexts.
DOMAINS = "(?i)(com|org|net|edu|gov|io|de|fr|es|uk)$"
NEAR = "(?i)(tel|phone|call|fax|mobile|contact|mail|reach|ssn|social security|account|iban|card|visa|login|credential|key|token|secret|password)"
FAR = "(?i)(version|invoice|order|isbn|page|figure|table|price|total|year|copyright|no[.])"
LABELERS = ["shape", "check", "gazetteer", "near", "far"]
#: Traits of a match x that the classifier sees besides the votes.
TRAITS = {"long": "length(x.m) >= 24", "digits": "length(regexp_replace(x.m, '[^0-9]', '')) >= 9", "mixed": "x.m rlike '[0-9][A-Za-z]|[A-Za-z][0-9]'"}
FEATURES = [f"{n}{v}" for n in LABELERS for v in (0, 1)] + [f"is_{k}" for k, _ in LOOSE] + list(TRAITS)
#: Where the labelers start, and how often they abstain is learned from there: (says 1 when true, says 1 when false).
START = (0.8, 0.2)


def _quoted(p: str) -> str:
    return "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: str, pattern: str, needs: str) -> str:
    """SQL: array of (m, start, stop) of all matches, in code points."""
    p = _quoted(pattern)
    seen = f"instr(_text, '{needs}') > 0" if needs else "true"
    return f"CASE WHEN {seen} THEN regexp_extract_all(_text, {p}, 0) ELSE cast(array() as array<string>) END", f"split(_text, {p}, -1)"


def _running(items: str, start: str, kind: str, step: str, join: str) -> str:
    """SQL: the running value at each element x of array ``items``: ``start``, moved on by ``step`` (of a.at and x) or by a whole block's value y (``join``). Blocks of 512, as arrays grow by copying."""
    block = f"aggregate(slice({items}, 512 * b + 1, 512), struct({start} AS at, cast(array() as array<{kind}>) AS out), (a, x) -> struct({step} AS at, concat(a.out, array({step})) AS out), a -> a.out)"
    blocks = f"transform(sequence(0, greatest(size({items}) - 1, 0) div 512), b -> {block})"
    end = join.replace("y", "try_element_at(x, -1)")
    return f"aggregate({blocks}, struct({start} AS at, cast(array() as array<{kind}>) AS out), (a, x) -> struct(IF(size(x) = 0, a.at, {end}) AS at, concat(a.out, transform(x, y -> {join})) AS out), a -> a.out)"


def _spans(d: DataFrame, kind: str, pattern: str, needs: str) -> DataFrame:
    """Adds column ``kind``: array of struct(kind, m, start, stop)."""
    found, gaps = _found(kind, pattern, needs)
    d = d.withColumn("_m", F.expr(found)).withColumn("_g", F.expr(f"CASE WHEN size(_m) > 0 THEN {gaps} ELSE cast(array() as array<string>) END"))
    # Arrays meet as arguments of zip_with, never inside a lambda: what a lambda refers to may be computed for every element.
    d = d.withColumn("_l", F.expr("zip_with(_m, slice(_g, 1, size(_m)), (x, g) -> length(g) + length(x))"))
    d = d.withColumn("_e", F.expr(_running("_l", "0", "int", "a.at + x", "a.at + y")))
    out = d.withColumn(kind, F.expr(f"zip_with(_m, _e, (x, e) -> struct('{kind}' AS kind, x AS m, e - length(x) AS start, e AS stop))"))
    return out.drop("_m", "_g", "_l", "_e")


def _free(d: DataFrame) -> DataFrame:
    """Adds ``_free``: the loose matches that overlap no base span and no loose match of an earlier kind."""
    ranks = range(len(LOOSE))
    none = 1 << 30
    kinds = ", ".join(f"'{k}'" for k, _ in LOOSE)
    base = f"transform(concat({', '.join(k for k, *_ in BASE)}), b -> struct(b.start AS start, 0 AS rank, b.stop AS stop, '' AS kind, '' AS m))"
    loose = f"transform(concat({', '.join(k for k, *_ in LOOSE)}), x -> struct(x.start AS start, cast(array_position(array({kinds}), x.kind) as int) AS rank, x.stop AS stop, x.kind AS kind, x.m AS m))"
    # in order of start; of equal starts the earlier kind first
    some = " + ".join(f"size({k})" for k, _ in LOOSE)
    d = d.withColumn("_all", F.expr(f"CASE WHEN {some} > 0 THEN sort_array(concat({base}, {loose})) ELSE array() END")).withColumn("_back", F.expr("reverse(_all)"))
    row = f"struct<{','.join(f'm{r}:int' for r in ranks)}>"
    fold = lambda fn, mine: "struct(" + ", ".join(f"{fn}(a.at.m{r}, {mine(r)}) AS m{r}" for r in ranks) + ")"
    first = lambda v: f"cast(struct({', '.join(f'{v} AS m{r}' for r in ranks)}) as {row})"
    # for each rank: how far the earlier kinds reach from the left, and where the next of them starts
    reach = _running("_all", first(0), row, fold("greatest", lambda r: f"IF(x.rank <= {r}, x.stop, 0)"), fold("greatest", lambda r: f"y.m{r}"))
    ahead = _running("_back", first(none), row, fold("least", lambda r: f"IF(x.rank <= {r}, x.start, {none})"), fold("least", lambda r: f"y.m{r}"))
    d = d.withColumn("_reach", F.expr(reach)).withColumn("_ahead", F.expr(ahead))
    # each match with the values before and after it
    d = d.withColumn("_before", F.expr(f"concat(array({first(0)}), _reach)")).withColumn("_after", F.expr(f"slice(concat(reverse(_ahead), array({first(none)})), 2, size(_all))"))
    clash = "CASE x.rank " + " ".join(f"WHEN {r + 1} THEN b.m{r} > x.start OR a.m{r} < x.stop" for r in ranks) + " ELSE true END"
    d = d.withColumn("_marked", F.expr(f"zip_with(zip_with(_all, slice(_before, 1, size(_all)), (x, b) -> struct(x, b)), _after, (p, a) -> struct(p.x AS x, {clash.replace('x.', 'p.x.').replace('b.m', 'p.b.m')} AS clash))"))
    d = d.withColumn("_free", F.expr("transform(filter(_marked, x -> NOT x.clash), x -> x.x)"))
    return d.drop("_all", "_back", "_reach", "_ahead", "_before", "_after", "_marked")


def _luhn(m: str) -> str:
    digits = f"reverse(regexp_replace({m}, '[^0-9]', ''))"
    return f"""aggregate(transform(split({digits}, ''), (c, i) -> IF(c = '', 0, IF(i % 2 = 0, cast(c as int),
        IF(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int))))), 0, (a, x) -> a + x) % 10 = 0"""


_N_DIGITS = "length(regexp_replace(x.m, '[^0-9]', ''))"
#: What a base match must also pass.
PASSES = {
    "email": "true",
    "ip": "size(filter(split(x.m, '[.]'), p -> coalesce(try_cast(p as bigint) > 255, true))) = 0",
    "card": f"{_N_DIGITS} BETWEEN 16 AND 19 AND {_luhn('x.m')}",
    "phone": f"{_N_DIGITS} BETWEEN 8 AND 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _text, and an array for each base kind."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    for kind, pattern, needs in BASE:
        d = _spans(d, kind, pattern, needs)
        d = d.withColumn(kind, F.expr(f"filter({kind}, x -> {PASSES[kind]})"))
    return d


def candidates(d: DataFrame) -> DataFrame:
    """Adds ``cands``: array of struct(kind, start, stop, votes, traits) of the loose matches of ``_free``."""
    for kind, pattern in LOOSE:
        d = _spans(d, kind, pattern, {"contact": "at"}.get(kind, ""))
    d = _free(d)
    left = "substring(_text, greatest(x.start - 39, 1), least(x.start, 40))"
    vote = lambda yes, no: f"CASE WHEN {yes} THEN 1 WHEN {no} THEN 0 ELSE -1 END"
    n = _N_DIGITS
    votes = {
        "shape": vote(
            "x.kind = 'contact' OR (x.kind = 'secret' AND x.m rlike '[0-9A-Fa-f]{16,}|[0-9]+[A-Za-z]+[0-9]+') OR (x.kind = 'number' AND x.m rlike '^([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{4})$')",
            "x.kind = 'number' AND x.m rlike '^[0-9]+$'",
        ),
        "check": vote(f"(x.kind = 'number' AND {n} BETWEEN 13 AND 19 AND {_luhn('x.m')}) OR (x.kind = 'secret' AND length(x.m) >= 28)", f"(x.kind = 'number' AND {n} BETWEEN 13 AND 19) OR (x.kind = 'secret' AND length(x.m) < 16)"),
        "gazetteer": vote(f"(x.kind = 'contact' AND x.m rlike '{DOMAINS}') OR (x.kind = 'number' AND x.m rlike '^(555|800|888)[ .-]')", "x.m rlike '(?i)(example|changeme|xxxx|0000000)'"),
        "near": vote(f"{left} rlike '{NEAR}' OR x.kind = 'secret'", "false"),
        "far": vote("false", f"{left} rlike '{FAR}'"),
    }
    struct = ", ".join(f"'{k}', {v}" for k, v in (votes | {t: f"coalesce({x}, false)" for t, x in TRAITS.items()}).items())
    return d.withColumn("cands", F.expr(f"transform(_free, x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop, {struct}))"))


def em(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list, dict]:
    """Prior, reliabilities (P(vote | true), P(vote | false) for votes -1, 0, 1) and the posterior of each vote pattern."""
    prior = 0.5
    rel = [({1: START[0], 0: 1 - START[0], -1: 1.0}, {1: START[1], 0: 1 - START[1], -1: 1.0}) for _ in LABELERS]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v, _n in counts:
            odds = math.log(prior) - math.log(1 - prior) + sum(math.log(t[x]) - math.log(f[x]) for x, (t, f) in zip(v, rel, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(n for _, n in counts) or 1
        prior = min(0.95, max(0.05, sum(n * post[v] for v, n in counts) / total)) if counts else 0.5
        new = []
        for i in range(len(LABELERS)):
            sides = []
            for true, start in ((True, START[0]), (False, START[1])):
                # the starting beliefs weigh as 20 votes, so a labeler seldom heard keeps them; saying nothing is no evidence
                n1 = 20 * start + sum(n * (post[v] if true else 1 - post[v]) for v, n in counts if v[i] == 1)
                n0 = 20 * (1 - start) + sum(n * (post[v] if true else 1 - post[v]) for v, n in counts if v[i] == 0)
                p = min(0.98, max(0.02, n1 / (n1 + n0)))
                sides.append({1: p, 0: 1 - p, -1: 1.0})
            new.append(tuple(sides))
        rel = new
    return prior, rel, post


def train(counts: list[tuple[str, tuple[int, ...], tuple[bool, ...], int]], steps: int = 300) -> tuple[float, dict[str, float]]:
    """Bias and weights of the span classifier, from the EM posteriors of (kind, votes, traits, count)."""
    merged: dict[tuple[int, ...], int] = {}
    for _, v, _, n in counts:
        merged[v] = merged.get(v, 0) + n
    _, _, post = em(sorted(merged.items()))
    rows = [([f"{LABELERS[i]}{x}" for i, x in enumerate(v) if x >= 0] + [f"is_{k}"] + [t for t, on in zip(TRAITS, has, strict=True) if on], post[v], n) for k, v, has, n in sorted(counts)]
    bias, w, total = 0.0, dict.fromkeys(FEATURES, 0.0), sum(n for *_, n in rows) or 1
    for _ in range(steps):
        g0, g = 0.0, dict.fromkeys(FEATURES, 0.0)
        for fs, y, n in rows:
            e = (1 / (1 + math.exp(-(bias + sum(w[f] for f in fs)))) - y) * n / total
            g0 += e
            for f in fs:
                g[f] += e
        bias -= 2.0 * g0
        w = {f: x - 2.0 * (g[f] + 1e-3 * x) for f, x in w.items()}
    return bias, w


def score(bias: float, w: dict[str, float]) -> str:
    """SQL: the classifier's log odds of candidate ``x``."""
    terms = [f"CASE x.{n} WHEN 1 THEN {w[n + '1']:.6f}D WHEN 0 THEN {w[n + '0']:.6f}D ELSE 0D END" for n in LABELERS]
    terms += [f"IF(x.{t}, {w[t]:.6f}D, 0D)" for t in TRAITS]
    kinds = " ".join(f"WHEN '{k}' THEN {w['is_' + k]:.6f}D" for k, _ in LOOSE)
    return f"({bias:.6f}D + {' + '.join(terms)} + CASE x.kind {kinds} ELSE 0D END)"


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every row of ``docs`` (doc_id, text)."""
    d = candidates(base_spans(docs))
    slim = "transform({0}, x -> struct(x.kind AS kind, x.start AS start, x.stop AS stop))"
    all_base = f"concat({', '.join(slim.format(k) for k, *_ in BASE)})"
    d = materialize(d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE), F.expr(all_base).alias("base"), "cands"), "pii")
    votes = d.select(F.explode("cands").alias("c")).groupBy("c.kind", *(f"c.{n}" for n in [*LABELERS, *TRAITS])).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 * 3^5 * 2^3 rows
    bias, w = train([(r["kind"], tuple(r[n] for n in LABELERS), tuple(r[t] for t in TRAITS), r["n"]) for r in votes])
    kept = f"filter(cands, x -> {score(bias, w)} > 0)"
    order = F.expr(f"concat(base, array_sort({slim.format(kept)}, (a, b) -> CASE WHEN a.kind <> b.kind THEN IF(array_position(array({', '.join(map(repr, KINDS))}), a.kind) < array_position(array({', '.join(map(repr, KINDS))}), b.kind), -1, 1) ELSE a.start - b.start END))")
    d = d.withColumn("_all", order)
    return d.select("doc_id", *(f"n_{k}" for k, *_ in BASE), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("_all").alias("spans"))
