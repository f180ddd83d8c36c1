"""Chains, summaries and reasoning paths with models that are column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import services as V
from terrane.operators import chains as C
from terrane.operators import evaluation as E
from terrane.operators import training as N
from terrane.runtime import table


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items")


def _cached(s, d):
    """The answers of every other question; one in five is no JSON."""
    i = _items(s, d).where("item_id % 2 = 0").groupBy("question").agg(F.min_by(F.struct("item_id", "answer", "passage"), "item_id").alias("x"))
    json = F.to_json(F.struct(F.upper("question").alias("query"), F.col("x.answer").alias("result"), F.array("x.passage").alias("source_documents")))
    return i.select(F.col("question").alias("query"), F.when(F.col("x.item_id") % 5 == 0, F.concat(F.lit("plain "), "x.answer")).otherwise(json).alias("answer"))


def _model_chain(q: DataFrame) -> DataFrame:
    return q.select("query", F.to_json(F.struct("query", F.concat(F.lit("about "), "query").alias("result"), F.array().cast("array<string>").alias("source_documents"))).alias("answer"))


def _run(s, d):
    asked = _items(s, d).select(F.col("question").alias("query"))
    return C.cache_chain(asked, _cached(s, d), _model_chain)


def cache_chain(s, d):
    a = _run(s, d)[0]
    return a.select("query", "hit", F.get_json_object("answer", "$.query").alias("named"), F.coalesce(F.get_json_object("answer", "$.result"), F.col("answer")).alias("result"))


def cache_chain_update(s, d):
    return _run(s, d)[1].select("query").distinct()


def summarize_short(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", "text")
    return C.summarize(t, lambda x: F.concat(F.substring(x, 1, 20), F.lit("...")), 60).select("doc_id", F.md5("text").alias("text"))


def _paths(s, d):
    """The model numbers its sub-queries and repeats the second one; the documents found are the item's passage."""
    q = _items(s, d).select(F.col("item_id").alias("item"), "question", "passage")
    ask = lambda p: F.concat(F.lit("<reasoning>so</reasoning>Step 1: sub"), F.least(F.regexp_count(p, F.lit("Intermediate query")), F.lit(1)).cast("string"))
    find = lambda x: x.join(q.select("item", F.array("passage").alias("docs")), "item").select("item", "docs")
    return C.sample_paths(q, ask, find, lambda p: F.right(p, F.lit(4)), "Find out.", 3)


def path_sampling(s, d):
    flat = lambda c: F.array_join(c, "|").alias(c)
    return _paths(s, d).select("item", flat("subqueries"), flat("subanswers"), flat("thoughts"), F.size("documents").alias("n"))


def final_answer(s, d):
    return C.final_answers(_paths(s, d), lambda p: F.right(p, F.lit(9)), "Answer.")


def naive_answer(s, d):
    q = _items(s, d).select(F.col("item_id").alias("item"), "question", F.array("passage").alias("docs"))
    return C.naive_answers(q, lambda p: F.right(p, F.lit(7)))


def train_data(s, d):
    """The model asks a passage's first and last ten characters, prefers by the parity of the query's length, and rewrites
    with the number of the rewrite; the features are two lengths."""
    docs = _items(s, d).select(F.col("item_id").alias("doc_id"), F.col("passage").alias("content"))
    ask = lambda t: F.concat(F.lit("Q1: "), _bare(F.left(t, F.lit(10))), F.lit("a\n\nQ2: "), _bare(F.right(t, F.lit(10))), F.lit("z"))
    scores = [lambda q, t: F.length(t), lambda q, t: F.length(q) % 5]
    judge = lambda q, t: F.when(F.length(q) % 2 == 0, "score 0.9").otherwise("0.3")
    x = N.train_data(docs, ask, scores, judge, lambda q, n: F.concat(q, F.lit("#"), n.cast("string")))
    return x.select("query", F.md5("corpus").alias("corpus"), "rewrite_no")


def _bare(c):
    return F.translate(c, "\n\r\t :：", "")


def evaluation_data(s, d):
    docs = _items(s, d).select(F.col("item_id").alias("doc_id"), F.col("passage").alias("content"))
    return N.evaluation_data(docs, lambda t: F.concat(F.lit("Question1："), _bare(F.left(t, F.lit(10))), F.lit("a"))).select("query", F.md5("corpus").alias("corpus"))


def service_answers(s, d):
    """Sparse, dense and rerank answers of a service, made from the order of each event."""
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("k"))
    sparse = V.sparse_vector(F.format_string('[{"index": %d, "value": 1.5}, {"index": 9, "value": 2.0}, {"index": %d, "value": 0.25}]', "k", "k"))
    dense = V.dense_vectors(F.format_string('{"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [%d.5]}]}', "k"))
    rank = V.rerank_scores(F.format_string('[{"index": %d, "score": 0.5}, {"index": 7, "score": 0.25}]', "k"), F.lit(9))
    return e.select("event_id", sparse[F.col("k")].alias("low"), F.size(F.map_keys(sparse)).alias("n"), F.flatten(dense)[0].alias("first"), F.array_position(rank, 0.5).alias("at"), F.size(rank).alias("scores"), F.aggregate(rank, F.lit(0.0), lambda a, x: a + x).alias("sum"))


def rag_metrics(s, d):
    """All metrics on verdicts made of the items' numbers."""
    i = _items(s, d).select(F.col("item_id").alias("item"))
    part = i.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4))))
    bit = lambda m: ((F.col("item") + F.col("n")) % m == 0).cast("int")
    verdict, ranked = part.select("item", bit(2).alias("verdict")), part.select("item", F.col("n").alias("rank"), bit(2).alias("relevant"))
    rating = part.select("item", F.when(F.col("n") == 4, 9.0).otherwise(F.col("n") - 1).alias("rating"))
    m = {k: rating for k in ("nv_accuracy", "nv_context_relevance", "nv_response_groundedness")} | {"faithfulness": verdict, "context_recall": verdict, "context_precision": ranked, "context_utilization": ranked}
    m |= {"answer_correctness": i.select("item", (F.col("item") % 3).alias("tp"), F.lit(1).alias("fp"), F.lit(1).alias("fn"), F.lit(0.5).alias("similarity")), "answer_similarity": i.select("item", F.lit(0.5).alias("similarity"))}
    m |= {"answer_relevancy": part.select("item", F.lit(0.25).alias("score"), bit(7).alias("evasive")), "noise_sensitivity": part.select("item", bit(2).alias("correct"), F.lit(1).alias("supported")), "context_entity_recall": i.select("item", F.array(F.lit("a"), F.lit("b")).alias("found"), F.array(F.lit("b"), F.lit("c")).alias("wanted"))}
    return E.evaluate(m | {"unknown": i})


_BARE = "regexp_replace({}, '[' || chr(10) || chr(13) || chr(9) || ' :：]', '', 'g')"
_C = "c AS (SELECT question, arg_min(answer, item_id) AS answer, min(item_id) AS k FROM eval_items WHERE item_id % 2 = 0 GROUP BY 1)"

QUERIES = {"cache_chain": cache_chain, "cache_chain_update": cache_chain_update, "summarize_short": summarize_short, "path_sampling": path_sampling, "final_answer": final_answer, "naive_answer": naive_answer, "train_data": train_data, "evaluation_data": evaluation_data, "service_answers": service_answers, "rag_metrics": rag_metrics}
SQL = {
    "train_data": f"WITH a AS (SELECT item_id, 0 AS pos, {_BARE.format('left(passage, 10)')} || 'a' AS query, passage FROM eval_items WHERE trim(passage) <> '' UNION ALL SELECT item_id, 2, {_BARE.format('right(passage, 10)')} || 'z', passage FROM eval_items WHERE trim(passage) <> ''), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY item_id, pos) AS k FROM a) WHERE k = 1), p AS (SELECT *, row_number() OVER (ORDER BY item_id, pos) AS pair_id FROM u), l AS (SELECT 0 AS list_no, row_number() OVER (ORDER BY length(passage) DESC, pair_id) - 1 AS rank, pair_id FROM p UNION ALL SELECT 1, row_number() OVER (ORDER BY length(query) % 5 DESC, pair_id) - 1, pair_id FROM p), s AS (SELECT pair_id, round(sum(1.0 / (rank + 60)), 9) AS score, min(list_no * 1000000000 + rank) AS seen FROM l GROUP BY 1), r AS (SELECT pair_id, row_number() OVER (ORDER BY score DESC, seen) AS k FROM s), kept AS (SELECT p.* FROM p JOIN r USING (pair_id) WHERE r.k <= (SELECT round_even(count(*) * 0.8, 0) FROM p) AND length(query) % 2 = 0) SELECT CASE WHEN n = 0 THEN query ELSE query || '#' || n END AS query, md5(passage) AS corpus, n::INT AS rewrite_no FROM kept, range(3) t(n)",
    "evaluation_data": f"WITH a AS (SELECT item_id, {_BARE.format('left(passage, 10)')} || 'a' AS query, passage FROM eval_items WHERE trim(passage) <> '') SELECT query, md5(arg_min(passage, item_id)) AS corpus FROM a GROUP BY 1",
    "service_answers": "SELECT event_id, 0.25::DOUBLE AS low, 2 AS n, event_id % 7 + 0.5::DOUBLE AS first, event_id % 7 + 1 AS at, 9 AS scores, 0.75::DOUBLE AS sum FROM events",
    "rag_metrics": "WITH i AS (SELECT item_id AS item FROM eval_items), m AS (SELECT item, unnest(['nv_accuracy', 'nv_context_relevance', 'nv_response_groundedness', 'faithfulness', 'context_recall', 'context_precision', 'context_utilization', 'answer_correctness', 'answer_similarity', 'answer_relevancy', 'noise_sensitivity', 'context_entity_recall']) AS metric FROM i) SELECT item, metric, round(CASE WHEN metric = 'nv_accuracy' THEN 0.25 WHEN metric LIKE 'nv%' THEN 0.5 WHEN metric IN ('faithfulness', 'context_recall', 'noise_sensitivity', 'answer_similarity', 'context_entity_recall') THEN 0.5 WHEN metric LIKE 'context_%' THEN CASE WHEN item % 2 = 1 THEN (1 + 2.0 / 3) / 2 ELSE 0.5 END WHEN metric = 'answer_correctness' THEN 0.75 * (item % 3) / (item % 3 + 1) + 0.125 ELSE CASE WHEN (item + 1) % 7 = 0 OR (item + 2) % 7 = 0 OR (item + 3) % 7 = 0 OR (item + 4) % 7 = 0 THEN 0 ELSE 0.25 END END, 6) AS value FROM m",
    "cache_chain": f"WITH {_C}, q AS (SELECT DISTINCT question FROM eval_items) SELECT q.question AS query, k IS NOT NULL AS hit, CASE WHEN k % 5 = 0 THEN NULL ELSE q.question END AS named, CASE WHEN k IS NULL THEN 'about ' || q.question WHEN k % 5 = 0 THEN 'plain ' || answer ELSE answer END AS result FROM q LEFT JOIN c ON c.question = q.question",
    "cache_chain_update": "SELECT DISTINCT question AS query FROM eval_items",
    "summarize_short": "SELECT doc_id, md5(CASE WHEN length(text) > 60 THEN substr(text, 1, 20) || '...' ELSE text END) AS text FROM documents WHERE text IS NOT NULL",
    "path_sampling": "SELECT item_id AS item, 'sub0|sub1' AS subqueries, 'sub0|sub1' AS subanswers, 'so|so' AS thoughts, 2 AS n FROM eval_items",
    "final_answer": "SELECT item_id AS item, trim(right(question, 9)) AS answer FROM eval_items",
    "naive_answer": "SELECT item_id AS item, trim(right(question, 7)) AS answer FROM eval_items",
}
