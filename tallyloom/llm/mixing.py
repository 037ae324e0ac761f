"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9), DataFrame functions only.

Sources get weights 5, 2, 1, 5, ... in code point order (null last) and share the
total number of words; a target stops at ``max_epochs`` times its source's words and
the excess goes to the others by weight. Whole epochs come first. The rest of a
target is filled without replacement: each document draws the key -ln(u) / w, with u
hashed from its doc_id (from its text, where that is null) and w its quality weight, and documents are taken in order of
key while the running sum of words stays nearest the rest.

The order is never built. Word counts of key buckets (equal steps of the key's logarithm) find the
bucket that a source's rest falls into; that one is cut into ranges of about ``RANGE_ROWS`` documents by its own count,
their word counts find the range, and only that range is ordered row
by row. So a source with a third of all rows is never ordered in one task. Texts are split into words once.

Nulls: a null text has no words, a null source is a source of its own. Rows that are equal in everything are separate documents; which of
them is taken cannot be told apart. Ties in key go by doc_id, then size. Very long texts are measured whole. Reruns
agree. ``mix`` ignores other columns; ``mixed`` keeps them, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

WEIGHTS = [5, 2, 1]
MAX_EPOCHS = 3
#: Documents in a key range, about, and buckets for each unit of the key's logarithm.
RANGE_ROWS, STEPS = 2_000, 16
SEED = "mix-1"


SIZE = r"cast(size(array_remove(split(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), '')) as bigint)"


def _key(doc_id, text):
    """A document's place in its source's order: -ln(u) / w."""
    text = F.coalesce(text, F.lit(""))
    # quality weight: from 1 for clean text down to 1/4 where a sixth or more of its characters are litter
    litter = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    weight = F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(4.5) * litter / F.greatest(F.length(text), F.lit(1)))
    name = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")))
    draw = F.conv(F.substring(F.md5(F.concat(name, F.lit(":" + SEED)).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((draw + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and key of every row, written: the only pass that splits texts."""
    m = docs.select("doc_id", "source", F.expr(SIZE.format("text")).alias("size"), _key(F.col("doc_id"), F.col("text")).alias("key"))
    return materialize(m, "mix")


def targets(m: DataFrame, weights: list[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, sid, source_size, target, n): a row for each source."""
    s = m.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)
    # A window over the sources, not the documents.
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    everything = Window.partitionBy()
    s = s.withColumns({"cap": max_epochs * F.col("source_size"), "total": F.sum("source_size").over(everything), "w_all": F.sum("w").over(everything)})
    s = s.withColumn("fill", F.col("cap") / F.col("w"))  # the level at which a source is full
    before = Window.orderBy("fill", "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0))))
    first = Window.orderBy("fill", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("water", F.first(F.when(F.col("level") <= F.col("fill"), F.col("level")), ignorenulls=True).over(first))
    target = F.when(F.col("water") < F.col("fill"), F.col("water") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "sid", "source_size", target.alias("target"), "n")


def _cuts(m: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """A row for each source: source_size, target, epochs, rest, and where the rest ends: bucket, ranges of that bucket, range, and the words before that range."""
    t = targets(m, weights, max_epochs)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    t = materialize(t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "name").drop("n"), "mix-sources")

    def first_over(sums: DataFrame, by: str, start) -> DataFrame:
        """The first of the counts that ends after the rest, for each source."""
        upto = start + F.sum("words").over(Window.partitionBy("sid").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        over = sums.withColumn("start", upto - F.col("words")).where(F.col("start") + F.col("words") > F.col("rest"))
        return over.groupBy("sid").agg(F.min(F.struct(by, "start", "n")).alias("x"))

    placed = _bucketed(m.join(t.select("name", "sid", "rest"), F.col("source").eqNullSafe(F.col("name"))))
    sums = placed.groupBy("sid", "rest", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    cut = first_over(sums, "bucket", F.lit(0)).select("sid", F.col("x.bucket").alias("cut"), F.col("x.start").alias("before"), F.ceil(F.col("x.n") / RANGE_ROWS).alias("ranges"))
    t = materialize(t.join(cut, "sid", "left"), "mix-cuts")
    placed = _ranged(_bucketed(m.join(t, F.col("source").eqNullSafe(F.col("name"))))).where("bucket = cut")
    sums = placed.groupBy("sid", "rest", "before", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    cut = first_over(sums, "range", F.col("before")).select("sid", F.col("x.range").alias("cut_range"), F.col("x.start").alias("start"))
    return materialize(t.join(cut, "sid", "left").drop("before"), "mix-cuts")


def _bucketed(d: DataFrame) -> DataFrame:
    return d.withColumn("bucket", F.floor(F.log("key") * STEPS))


def _ranged(d: DataFrame) -> DataFrame:
    low, high = (F.exp((F.col("cut") + i) / STEPS) for i in (0, 1))
    return d.withColumn("range", F.floor((F.col("key") - low) / (high - low) * F.col("ranges")))


def _fill(rows: DataFrame, cuts: DataFrame, size) -> DataFrame:
    """``rows`` (doc_id, source, key) with source_size, target and copies; ``size`` is looked at only in the range that is ordered."""
    d = _ranged(_bucketed(rows.join(cuts, F.col("source").eqNullSafe(F.col("name")))))
    # 1: before the end of the rest, 0: after it, null: in the range where it ends
    side = F.expr("CASE WHEN cut IS NULL OR bucket < cut THEN 1 WHEN bucket > cut THEN 0 WHEN cut_range IS NULL OR range < cut_range THEN 1 WHEN range > cut_range THEN 0 END")
    d = d.withColumn("more", side)
    w = Window.partitionBy("sid").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = d.where("more IS NULL").withColumn("size", size)
    parts = parts.withColumn("run", F.col("start") + F.sum("size").over(w)).withColumn("more", F.expr("cast(2 * run - size <= 2 * rest as int)"))
    out = d.where("more IS NOT NULL")
    return out.unionByName(parts.select(*out.columns)).withColumn("copies", F.col("epochs") + F.when(F.col("rest") > 0, F.col("more")).otherwise(0))


def mix(docs: DataFrame, weights: list[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs`` (doc_id, text, source). One pass over the texts."""
    m = measured(docs)
    d = _fill(m, _cuts(m, weights, max_epochs), F.col("size"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: list[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns. Texts stay where they are: only small tables are joined to them."""
    # the caller's row as one column, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", _key(F.col("doc_id"), F.col("text")).alias("key"))
    d = _fill(rows, _cuts(measured(docs), weights, max_epochs), F.expr(SIZE.format("row.text"))).where("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


ORACLE = r"""
WITH m AS (
  SELECT doc_id, source, size, -ln((draw + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / greatest(0.25::DOUBLE, 1.0::DOUBLE - 4.5::DOUBLE * litter / greatest(len, 1)) AS key
  FROM (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
          length(coalesce(text, '')) AS len, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS litter,
          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':mix-1'), 1, 13))::BIGINT::DOUBLE AS draw FROM documents)),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM m GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS w FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS fill, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (w_all - coalesce(sum(w) OVER b, 0)) AS level FROM s2
       WINDOW b AS (ORDER BY fill, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT arg_min(level, (fill, sid)) FROM s3 WHERE level <= fill) AS water FROM s3),
t AS (SELECT source, source_size, CASE WHEN water < fill THEN water * w ELSE cap::DOUBLE END AS target FROM s4),
d AS (SELECT m.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
        sum(size) OVER (PARTITION BY m.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
      FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN 2 * run - size <= 2 * (target - epochs * source_size) AND target - epochs * source_size > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d
"""
