"""Training pairs, prompts, paths, splitting, hooks and files over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import hooks as H
from terrane.functions.splitting import blocks_column, split_documents
from terrane.operators import curation as C
from terrane.runtime import spread, table


def qd_pairs(s: SparkSession, d: str) -> DataFrame:
    """Lines of the documents as generated questions, first occurrence kept."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", C.question_lines(F.col("text")).alias("q"))
    return C.qd_pairs(docs, F.col("q")).select("doc_id", "pos", F.md5("query").alias("query"))


def rewrite_pairs(s, d):
    p = table(s, d, "eval_items").select("item_id", F.col("question").alias("query"))
    return C.rewrites(p, 2, lambda q, n: F.when((F.col("item_id") + n) % 4 == 0, F.lit("")).otherwise(F.concat(q, F.lit(" #"), n.cast("string"))))


def prompt_build(s, d):
    p = table(s, d, "correctness_classifier").where("question is not null").select("pair_id", "question", F.array_compact(F.coalesce("ground_truth", F.array().cast("array<string>"))).alias("docs")).distinct()
    return p.select("pair_id", F.md5(C.user_prompt(F.col("question"), F.col("docs"), " Answer briefly.")).alias("prompt"))


def subquery_prompt(s, d):
    p = table(s, d, "correctness_classifier").where("answer is not null").dropDuplicates(["pair_id"])
    return p.select("pair_id", F.md5(C.indexed(F.array_compact("answer"), "Step")).alias("prompt"))


def path_samples(s, d):
    p = table(s, d, "correctness_classifier").where("answer is not null").dropDuplicates(["pair_id"]).select(F.col("pair_id").alias("item"), F.array_compact("answer").alias("steps"))
    return C.path_samples(p).select("item", "step", F.md5("content").alias("content"), F.md5("history").alias("history"))


def first_correct_path(s, d):
    a = table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") == "N").alias("correct"))
    return C.first_correct(a).select("item", "attempt")


def normal_results(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('","b"]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"docs":["'), "event_type", F.lit('"]}'))).otherwise(F.col("event_type")).alias("p"))
    return e.select("event_id", F.array_join(C.normal_results(F.col("p")), "|").alias("texts"))


def md_split(s, d):
    docs = spread(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return split_documents(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.length("piece")).alias("longest"))


def protected_blocks(s, d):
    docs = spread(table(s, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.explode(blocks_column(F.col("text"))).alias("b")).groupBy("b.type").agg(F.count(F.lit(1)).alias("n"))


def hook_embed(s, d):
    return table(s, d, "eval_items").select("item_id", F.size(H.embedder()(F.col("question"))).alias("dims"))


def hook_rerank(s, d):
    return table(s, d, "eval_items").select("item_id", H.scorer()(F.col("question"), F.col("passage")).alias("score"))


def chain_query(s, d):
    i = table(s, d, "eval_items")
    q = i.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    found = i.select(F.col("item_id").alias("query_id"), F.row_number().over(Window.partitionBy("item_id").orderBy("passage")).alias("rank"), F.col("passage").alias("content"))
    return C.answer_chain(q, found, H.generator(), "\nAnswer the question.").select("query_id", "result", F.size("source_documents").alias("n"))


def summary_tree(s, d):
    i = table(s, d, "eval_items").select(F.col("item_id").alias("item"), F.posexplode(F.split("passage", "(?<=[.。])")).alias("pos", "text"))
    return C.pack_summaries(i, lambda t: F.substring(t, 1, 60), 150)


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:问题|Q|Question)\d*[：:]', ''), ' ')), lambda x: x <> '')"

SQL = {
    "qd_pairs": f"WITH c AS (SELECT doc_id, {_LINES} AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(l) AS query, generate_subscripts(l, 1)::INT - 1 AS pos FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id, pos) AS k FROM p) SELECT doc_id, pos, md5(query) AS query FROM r WHERE k = 1",
    "rewrite_pairs": "SELECT item_id, CASE WHEN n = 0 THEN question ELSE question || ' #' || n END AS query, n::INT AS rewrite_no FROM eval_items, range(3) t(n) WHERE n = 0 OR (item_id + n) % 4 <> 0",
    "prompt_build": "WITH p AS (SELECT DISTINCT pair_id, question, list_filter(coalesce(ground_truth, []), lambda x: x IS NOT NULL) AS docs FROM correctness_classifier WHERE question IS NOT NULL) SELECT pair_id, md5(CASE WHEN len(docs) > 0 THEN array_to_string(docs, chr(10) || chr(10)) || ' Answer briefly.' || chr(10) || chr(10) || question ELSE question END) AS prompt FROM p",
    "subquery_prompt": "WITH p AS (SELECT DISTINCT ON (pair_id) pair_id, list_filter(answer, lambda x: x IS NOT NULL) AS a FROM correctness_classifier WHERE answer IS NOT NULL) SELECT pair_id, md5(array_to_string(list_transform(a, lambda x, i: 'Step ' || i || ': ' || x), chr(10))) AS prompt FROM p",
    "path_samples": "WITH p AS (SELECT DISTINCT ON (pair_id) pair_id AS item, list_filter(answer, lambda x: x IS NOT NULL) AS a FROM correctness_classifier WHERE answer IS NOT NULL), s AS (SELECT item, unnest(a) AS content, generate_subscripts(a, 1)::INT - 1 AS step FROM p), k AS (SELECT * FROM s WHERE trim(content, ' ') <> '') SELECT item, step, md5(content) AS content, md5(coalesce(string_agg(content, chr(10)) OVER (PARTITION BY item ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS history FROM k",
    "first_correct_path": "SELECT l_orderkey AS item, min(l_linenumber) AS attempt FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1",
    "hook_embed": "SELECT item_id, 64 AS dims FROM eval_items",
    "chain_query": r"SELECT item_id AS query_id, regexp_replace(question, '^\w+:\s*', '') AS result, 1 AS n FROM eval_items",
    "normal_results": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '|b' ELSE event_type END AS texts FROM events",
}
QUERIES = {k: globals()[k] for k in (*SQL, "md_split", "protected_blocks", "hook_rerank", "summary_tree")}
