"""URL filters (operator 10): pattern rules behind an index of literal tokens.

Each rule lists the literal tokens that any URL it fits must hold: runs of ASCII letters
and digits that stand whole in every such URL, cut as URLs are. Counting those tokens over
all URLs tells each rule's rarest one, and only that one is indexed. A URL's tokens fetch
its candidate rules; only those run their regular expression. A rule without a whole token
stands behind the empty token, which every URL has, so no rule is lost. Rules are a table,
so a long list joins like any other table; it is repeated for a number of salts, over which
the URLs of a frequent token spread.

Verdicts depend on the URL alone, so distinct URLs are judged once and joined back;
a URL that a third of all rows share costs one judgement. Nulls: a null URL, or one
without ``://``, has empty host and path and fits no rule (allow). Ties between rules
of equal length go to the smaller rule text. Very long URLs are judged whole. Rows that
repeat are judged alike and all returned; other columns are ignored, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path of a site rule, verdict); it fits the host and its subdomains where the path starts alike.
SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: (name, hyphenated words that stand in a host label or path segment): fixed values, marks of junk sites.
JUNK_MARKS = ["spam-farm", "cheap-pills", "casino-bonus", "free-money", "link-farm", "click-bait", "adult-cams", "replica-watches", "payday-loans", "crypto-giveaway"]


#: Parts into which the URLs of one token are dealt.
SALTS = 32


def _tokens(text: str) -> list[str]:
    return [t for t in re.split("[^0-9A-Za-z]+", text) if t]


def site_rule(rule: str, verdict: str) -> tuple[str, str, list[str], str, bool]:
    """A rule as (rule, pattern over 'host#path', tokens, verdict, is it a site rule). Neither side can hold '#'."""
    host, slash, path = rule.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    quoted = (re.sub(r"([^0-9A-Za-z])", r"\\\1", x) for x in (host, slash + path))
    # a host stands between dots and ends, so all its tokens are whole; a path's last one may go on in the URL
    last = len(_tokens(path)) - (path[-1:].isascii() and path[-1:].isalnum())
    return rule, r"^(?:[^#]*\.)?" + "#".join(quoted), _tokens(host) + _tokens(path)[:last], verdict, True


def mark_rule(mark: str) -> tuple[str, str, list[str], str, bool]:
    return mark, rf"(?:^|[./ _#]){mark.replace('-', '[-_]')}(?:[./ _#]|$)", _tokens(mark), "block", False


def default_rules() -> list[tuple[str, str, list[str], str, bool]]:
    return [*(site_rule(*r) for r in SITE_RULES), *(mark_rule(m) for m in JUNK_MARKS)]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, list[str], str, bool]]) -> DataFrame:
    """(rule, pattern, tokens, verdict, site): as literals, so that the optimizer knows the size."""
    lit = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({lit(r)}, {lit(p)}, CAST(array({', '.join(map(lit, t))}) AS array<string>), {lit(v)}, {str(s).lower()})" for r, p, t, v, s in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, pattern, tokens, verdict, site)")


def with_host_path(pages: DataFrame) -> DataFrame:
    return pages.withColumns(
        {
            "host": F.coalesce(F.translate(F.regexp_extract("url", "://([^/?#]*)", 1), UPPER, LOWER), F.lit("")),
            "path": F.coalesce(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("")),
        }
    )


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, site_verdict, marked) for each distinct host and path that some rule fits."""
    urls = urls.select("host", "path").distinct()
    # host labels keep their case folded; path segments are matched as they stand
    cut = F.expr("array_distinct(concat(filter(split(concat(host, ' ', path), '[^0-9A-Za-z]+'), t -> t <> ''), array('')))")
    tokens = urls.select("host", "path", F.explode(cut).alias("token"))
    wanted = rules.select("rule", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    counts = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).getField("token").alias("token"))
    index = rules.join(rarest, "rule").select("token", "rule", "pattern", "verdict", "site", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = tokens.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    fits = dealt.join(index, ["token", "salt"]).where(F.expr("concat(host, '#', path) RLIKE pattern"))
    best = F.when(F.col("site"), F.struct((-F.length("rule")).alias("n"), "rule", "verdict"))
    out = fits.groupBy("host", "path").agg(F.min(best).alias("best"), F.coalesce(F.bool_or(~F.col("site") & (F.col("verdict") == "block")), F.lit(False)).alias("marked"))
    return out.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("site_verdict"), "marked")


def filter_urls(pages: DataFrame, rules: list | None = None) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict."""
    pages = with_host_path(pages.select("page_id", "url"))
    judged = judge(pages, rules_table(pages.sparkSession, rules or default_rules()))
    verdict = F.coalesce("site_verdict", F.when(F.col("marked"), "block"), F.lit("allow"))
    return pages.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, h, pa, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                       ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v
      FROM (SELECT DISTINCT host, path FROM p), r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule,
       coalesce(v, CASE WHEN regexp_matches(p.host || ' ' || p.path, '(?:^|[./ _])(?:__MARKS__)(?:[./ _]|$)') THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path
""".replace("__MARKS__", "|".join(m.replace("-", "[-_]") for m in JUNK_MARKS))
