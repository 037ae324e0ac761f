"""Queries over token sequences, prompts and small expressions, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import sequences as Q
from ..functions import texts as X
from ..operators import traces as T
from ..sources.adapters import CANDIDATES_SQL, candidates, table
from .queries import query


def _ids(first, n):
    """``n`` numbers from ``first`` on."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (first + i).cast("int"))


@query("""WITH o AS (SELECT o_orderkey, range(o_custkey, o_custkey + greatest(o_orderkey % 40, 1)) AS r, range(o_orderkey, o_orderkey + greatest(o_custkey % 60, 1)) AS k FROM orders),
n AS (SELECT *, least(len(r), 16, 50) AS nr FROM o), m AS (SELECT *, least(len(k), 50 - nr) AS nk FROM n)
SELECT o_orderkey, array_to_string(list_concat(list_concat(list_concat([1, 2, 3], r[1:nr]), list_concat([4, 5], k[1:nk])), [9]), ',') AS ids, nr AS ref_tokens, nk AS kernel_tokens, len(r) AS ref_total, len(k) AS kernel_total, len(r) > nr OR len(k) > nk AS truncated FROM m""")
def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", _ids(F.col("o_custkey"), F.col("o_orderkey") % 40).alias("r"), _ids(F.col("o_orderkey"), F.col("o_custkey") % 60).alias("k"))
    return o.select("o_orderkey", Q.encoded_pair(F.col("r"), F.col("k"), [1, 2, 3], [4, 5], 9, 56, 16).alias("x")).select("o_orderkey", F.array_join("x.ids", ",").alias("ids"), "x.ref_tokens", "x.kernel_tokens", "x.ref_total", "x.kernel_total", "x.truncated")


@query("""SELECT doc_id, substr(text, 1, (length(text) // 3)::BIGINT) || coalesce(lang, '') AS prefix, source || substr(text, 1, (length(text) // 3)::BIGINT) || coalesce(lang, '') AS scored, greatest(0, 500 - length(substr(text, 1, (length(text) // 3)::BIGINT))) AS room
FROM documents""")
def prefix_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cut = F.expr("cast(length(text) div 3 as int)")
    return d.select("doc_id", Q.prefix_text(F.col("text"), cut, F.col("lang")).alias("prefix"), Q.scored_text(F.col("source"), F.col("text"), cut, F.col("lang")).alias("scored"), Q.budget(cut, 500).alias("room"))


@query("""WITH a AS (SELECT c_custkey, c_name AS plan, CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END || c_mktsegment AS code FROM customer),
s AS (SELECT *, '```python' || CASE WHEN starts_with(code, chr(10)) THEN '' ELSE chr(10) END AS seam FROM a)
SELECT c_custkey, '## Plan' || chr(10) || plan || seam || code AS text, 8 AS plan_char_start, 8 + length(plan) AS plan_char_end, 8 + length(plan) + length(seam) AS code_char_start, 8 + length(plan) + length(seam) + length(code) AS code_char_end FROM s""")
def pass_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    code = F.concat(F.when(F.col("c_custkey") % 3 == 0, "\n").otherwise(""), "c_mktsegment")
    return c.select("c_custkey", Q.assembled(F.col("c_name"), code).alias("x")).select("c_custkey", "x.*")


@query("""WITH o AS (SELECT o_orderkey, range(1, 2 + o_orderkey % 4) AS p, range(5, 6 + o_custkey % 3) AS c FROM orders)
SELECT o_orderkey, array_to_string(list_concat(p, c), ',') AS token_ids, array_to_string(list_concat(list_transform(p, lambda x: 0), list_transform(c, lambda x: 1)), ',') AS seg, len(p) AS n_plan_tokens, len(c) AS n_code_tokens FROM o""")
def joined_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def half(first, n):
        ids = F.transform(F.sequence(F.lit(0), n), lambda i: (first + i).cast("long"))
        two = F.transform(ids, lambda i: F.array(i, i + 1))
        lp = F.transform(ids, lambda i: -i.cast("double"))
        return F.struct(ids.alias("token_ids"), two.alias("topk_ids"), F.transform(two, lambda x: F.array(F.lit(-0.5), F.lit(-1.5))).alias("topk_lp"), lp.alias("sampled_lp"), F.transform(ids, lambda i: F.lit(1)).alias("sampled_rank"))

    o = table(spark, sf_dir, "orders")
    x = Q.joined_passes(half(F.lit(1), F.col("o_orderkey") % 4), half(F.lit(5), F.col("o_custkey") % 3))
    return o.select("o_orderkey", x.alias("x")).select("o_orderkey", F.array_join("x.token_ids", ",").alias("token_ids"), F.array_join("x.seg", ",").alias("seg"), "x.n_plan_tokens", "x.n_code_tokens")


@query("""SELECT p_partkey, rtrim(p_name, chr(10)) || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '## Input contract' || chr(10) || 'ModelNew is constructed as ModelNew(' || p_size || ') and called with 2 positional inputs, all on CUDA and contiguous:' || chr(10)
 || '  arg 1: float32, shape (' || p_size || ', 4)' || chr(10) || '  arg 2: float32, shape (7)' || chr(10) || 'This supersedes any shape stated in comments or docstrings above.' || chr(10) ELSE '' END
 || CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN chr(10) ELSE chr(10) || chr(10) END || p_brand || chr(10) ELSE '' END AS prompt FROM part""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    second = F.when(F.col("p_size") % 3 == 0, F.array(F.lit(7)))
    block = Q.contract(F.col("p_size").cast("string"), F.array(F.array(F.col("p_size"), F.lit(4)).cast("array<int>"), second))
    return p.select("p_partkey", Q.with_blocks(F.col("p_name"), block, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n"), "p_brand", F.lit("\n\n")))).alias("prompt"))


@query("""SELECT o_orderkey, array_to_string(list_slice(r, -12, -1), ',') AS tail, array_to_string(list_concat(r, list_transform(range(20 - len(r)), lambda i: 0)), ',') AS padded FROM (SELECT o_orderkey, range(o_custkey, o_custkey + greatest(o_orderkey % 20, 1)) AS r FROM orders)""")
def cut_and_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", _ids(F.col("o_custkey"), F.col("o_orderkey") % 20).alias("r"))
    return o.select("o_orderkey", F.array_join(Q.tail(F.col("r"), 12), ",").alias("tail"), F.array_join(X.pad_right(F.col("r"), F.lit(20), 0), ",").alias("padded"))


@query("""WITH t AS (SELECT l_orderkey, -l_discount - 0.01 AS lp, 1 + l_linenumber % 3 AS rank FROM lineitem)
SELECT avg(exp(lp)) AS mean_p1, avg((rank = 1)::INT) AS share_rank1, count(*) AS n FROM t""")
def rank1_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.array(-F.col("l_discount") - 0.01, F.lit(-9.0)).alias("topk_lp"), (1 + F.col("l_linenumber") % 3).alias("sampled_rank"))
    return T.rank1_calibration(t)


@query(f"""WITH {CANDIDATES_SQL} SELECT level, count(CASE WHEN correct AND runtime > 0 THEN base_mean / runtime END) AS n_dataset, sum(CASE WHEN correct AND runtime > 0 THEN base_mean / runtime END) AS dataset, sum(CASE WHEN correct AND runtime <> 0 THEN base_mean / runtime END) AS report,
 avg(1 / (1 + exp(-prm))) AS sigmoid, 100.0 * count(*) FILTER (correct) / count(*) AS correct_pct FROM candidates GROUP BY level""")
def speedup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    a = L.dataset_speedup(F.col("correct"), F.col("runtime"), F.col("base_mean"))
    b = L.report_speedup(F.col("correct"), F.col("runtime"), F.col("base_mean"))
    return c.groupBy("level").agg(F.count(a).alias("n_dataset"), F.sum(a).alias("dataset"), F.sum(b).alias("report"), F.avg(L.sigmoid(F.col("prm"))).alias("sigmoid"), L.percent(F.count_if("correct"), F.count(F.lit(1))).alias("correct_pct"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey || '_Name.py' WHEN 1 THEN 'dir/' || c_custkey || '_A' WHEN 2 THEN 'x' || c_custkey ELSE '9dir/name' END AS name FROM customer)
SELECT c_custkey, coalesce(try_cast(nullif(regexp_extract(list_extract(string_split(name, '/'), -1), '^([0-9]+)', 1), '') AS BIGINT), -1) AS problem_id FROM n""")
def problem_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    name = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(c_custkey, '_Name.py') WHEN 1 THEN concat('dir/', c_custkey, '_A') WHEN 2 THEN concat('x', c_custkey) ELSE '9dir/name' END")
    return table(spark, sf_dir, "customer").withColumn("k", k).select("c_custkey", X.problem_id_from_name(name, F.lit(-1).cast("long")).alias("problem_id"))


@query(r"""WITH d AS (SELECT doc_id, '```py' || chr(10) || replace(coalesce(text, ''), '. ', chr(10) || '```' || chr(10)) AS t FROM documents), g AS (SELECT doc_id, string_split_regex(t, '```([A-Za-z0-9_+#-]*)[ \t]*(\r?\n|$)') AS p, regexp_extract_all(t, '```[A-Za-z0-9_+#-]*[ \t]*(?:\r?\n|$)') AS m, regexp_extract_all(t, '```([A-Za-z0-9_+#-]*)[ \t]*(?:\r?\n|$)', 1) AS tags FROM d)
SELECT doc_id, len(m) AS n_fences, list_sum(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN tags[i] <> '' THEN length(p[i + 1]) ELSE 0 END))::BIGINT AS block_chars, len(list_filter(tags, lambda x: x <> '')) AS n_blocks FROM g""")
def fenced_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents whose sentences are parted by fences."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("```py\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n```\n"))).alias("t"))
    fences = d.select("doc_id", F.regexp_count("t", F.lit(r"```[A-Za-z0-9_+#-]*[ \t]*(?:\r?\n|$)")).cast("long").alias("n_fences"))
    blocks = X.fence_table(d, ["doc_id"], "t").groupBy("doc_id").agg(F.sum(F.col("b") - F.col("a")).alias("block_chars"), F.count(F.lit(1)).alias("n_blocks"))
    return fences.join(blocks, "doc_id")
