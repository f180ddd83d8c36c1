"""Normalisation, hybrid ranking, rank fusion, selection and compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import ranking as R
from terrane.operators import vectors as V
from terrane.runtime import table

_M = "query_id string, dense_score string, sparse_score string, rerank_score string"


def _results(s: SparkSession, d: str) -> DataFrame:
    """Dense and sparse hits of the retrieved documents, one row each."""
    m = table(s, d, "mx_document").select("mx_id", "document_name", F.from_json("metadata", _M).alias("m")).where("m.query_id is not null and document_name is not null")
    hit = lambda kind: m.select(F.col("m.query_id").cast("bigint").alias("query_id"), F.col("document_name").alias("content"), F.expr(f"nanvl(try_cast(m.{kind}_score AS double), null)").alias("score"), F.lit(kind).alias("retrieval_type"), F.col("mx_id").alias("pos"))
    return hit("dense").unionByName(hit("sparse")).withColumn("query", F.concat(F.lit("q"), F.col("query_id").cast("string")))


def minmax_by_type(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d).withColumn("normal", F.round(R.min_max("score", ["query_id", "retrieval_type"]), 6))
    return r.select("query_id", "retrieval_type", "pos", "normal")


def logistic_weight(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select("item_id", F.round(R.dense_weight(F.col("question")), 6).alias("weight"))


def hybrid_rerank(s: SparkSession, d: str) -> DataFrame:
    return R.hybrid(_results(s, d), 5)


def rrf(s: SparkSession, d: str) -> DataFrame:
    """Two lists: documents by length and by time."""
    docs = table(s, d, "documents").select("doc_id", "n_chars", "create_time")
    rank = lambda n, c: R.numbered(docs, [F.col(c).desc_nulls_last(), F.col("doc_id")]).select(F.lit(n).alias("list_no"), (F.col("number") - 1).alias("rank"), F.col("doc_id").alias("item"))
    return R.rrf(rank(0, "n_chars").unionByName(rank(1, "create_time")))


def feature_select(s: SparkSession, d: str) -> DataFrame:
    """Pairs ranked by two scores, fused, and the best 80 % kept (half to even)."""
    p = table(s, d, "correctness_classifier").dropDuplicates(["pair_id"]).select("pair_id", F.coalesce(F.length("question"), F.lit(0)).alias("a"), F.coalesce(F.size("ground_truth"), F.lit(0)).alias("b"))
    rank = lambda n, c: R.numbered(p, [F.col(c).desc(), F.col("pair_id")]).select(F.lit(n).alias("list_no"), (F.col("number") - 1).alias("rank"), F.col("pair_id").alias("item"))
    fused = R.rrf(rank(0, "a").unionByName(rank(1, "b")))
    return R.keep_best(fused, "score", 0.8, "position").select("item", "score")


def multi_query_dedup(s: SparkSession, d: str) -> DataFrame:
    """Results of sub-queries joined, first occurrence of a content kept in order."""
    r = _results(s, d).withColumn("sub", F.when(F.col("retrieval_type") == "dense", 0).otherwise(1))
    return R.first_seen(r, ["query_id", "content"], ["sub", "pos"]).select("query_id", "content", "sub", "pos")


def rerank_topk(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d).where("retrieval_type = 'dense'").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return R.top_k(r, ["query_id"], "score", "pos", 3).select("query_id", "pos", "rank")


def _sentences(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "eval_items").select("item_id", F.posexplode(T.sentences(F.col("passage"))).alias("pos", "text"))
    return p.withColumn("score", F.length("text") % 17).withColumn("label", F.col("pos") % 2).withColumn("similarity", F.col("score"))


def compress_rerank(s: SparkSession, d: str) -> DataFrame:
    return R.compress_by_score(_sentences(s, d), ["item_id"], 0.6)


def compress_cluster(s: SparkSession, d: str) -> DataFrame:
    return R.compress_by_cluster(_sentences(s, d), ["item_id"], 0.4)


def recall_quota(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d).select(F.col("query_id").alias("item"), F.when(F.col("retrieval_type") == "dense", 0).otherwise(1).alias("sub"), (F.col("pos") * 2 + F.when(F.col("retrieval_type") == "dense", 0).otherwise(1)).alias("pos"), "content")
    return R.recall_quota(r, 5)


def prefer_filter(s: SparkSession, d: str) -> DataFrame:
    """Pairs of a model score of at least 0.5, best first; the stand-in score is a number of the text."""
    p = table(s, d, "mx_document").select("mx_id", F.from_json("metadata", _M).alias("m"))
    return p.select("mx_id", T.parse_score(F.col("m.dense_score")).alias("score")).where("score >= 0.5").orderBy(F.col("score").desc(), "mx_id")


def score_to_similarity(s: SparkSession, d: str) -> DataFrame:
    """Cache similarity: case-insensitive equality is the greatest, else the clamped and shifted score."""
    m = table(s, d, "mx_document").select("mx_id", F.expr("try_cast(get_json_object(metadata, '$.rerank_score') AS double)").alias("x")).where("x is not null and not isnan(x)")
    return m.select("mx_id", F.round(F.least(F.greatest(F.col("x"), F.lit(-5.0)), F.lit(5.0)) + 5.0, 6).alias("similarity"))


_MJ = "m AS (SELECT mx_id, document_name, metadata::JSON AS j FROM mx_document WHERE json_valid(metadata))"
_RES = (
    "WITH " + _MJ + ", res AS (SELECT try_cast(j->>'query_id' AS BIGINT) AS query_id, document_name AS content, CASE WHEN NOT isnan(x) THEN x END AS score, k AS retrieval_type, mx_id AS pos FROM ("
    "SELECT *, try_cast(j->>'dense_score' AS DOUBLE) AS x, 'dense' AS k FROM m UNION ALL SELECT *, try_cast(j->>'sparse_score' AS DOUBLE), 'sparse' FROM m) WHERE j->>'query_id' IS NOT NULL AND document_name IS NOT NULL), "
    "nrm AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE (coalesce(score, 0) - lo) / (hi - lo) END AS s FROM (SELECT *, min(coalesce(score, 0)) OVER w AS lo, max(coalesce(score, 0)) OVER w AS hi FROM res WINDOW w AS (PARTITION BY query_id, retrieval_type))) "
)
_SENT = r"WITH c AS (SELECT item_id, list_filter(list_transform(CASE WHEN length(passage) > 10000 THEN [passage] ELSE string_split(regexp_replace(passage, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: trim(x)), lambda x: x <> '') AS l FROM eval_items), st AS (SELECT item_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM c), sc AS (SELECT *, length(text) % 17 AS score, pos % 2 AS label FROM st) "

QUERIES = {
    "minmax_by_type": minmax_by_type,
    "logistic_weight": logistic_weight,
    "hybrid_rerank": hybrid_rerank,
    "rrf": rrf,
    "feature_select": feature_select,
    "multi_query_dedup": multi_query_dedup,
    "rerank_topk": rerank_topk,
    "compress_rerank": compress_rerank,
    "compress_cluster": compress_cluster,
    "recall_quota": recall_quota,
    "prefer_filter": prefer_filter,
    "score_to_similarity": score_to_similarity,
}
SQL = {
    "minmax_by_type": _RES + "SELECT query_id, retrieval_type, pos, round(s, 6) AS normal FROM nrm",
    "logistic_weight": "SELECT item_id, round(0.4 + 0.3 / (1 + exp(-(length(question) - 6))), 6) AS weight FROM eval_items",
    "hybrid_rerank": _RES + ", dd AS (SELECT query_id, content, arg_max(s, pos) AS d FROM nrm WHERE retrieval_type = 'dense' GROUP BY 1, 2), ss AS (SELECT query_id, content, arg_max(s, pos) AS s FROM nrm WHERE retrieval_type = 'sparse' GROUP BY 1, 2), b AS (SELECT query_id, content, d, s, 0.4 + 0.3 / (1 + exp(-(length('q' || query_id) - 6))) AS w FROM dd FULL JOIN ss USING (query_id, content)), o AS (SELECT query_id, content, round(w * coalesce(d, 0) + (1 - w) * coalesce(s, 0), 6) AS score, CASE WHEN d IS NULL THEN 'sparse' WHEN s IS NULL THEN 'dense' ELSE 'both' END AS retrieval_type FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content) AS rank FROM o) SELECT * FROM r WHERE rank <= 5",
    "rrf": "WITH l AS (SELECT 0 AS list_no, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) - 1 AS rank, doc_id AS item FROM documents UNION ALL SELECT 1, row_number() OVER (ORDER BY create_time DESC NULLS LAST, doc_id) - 1, doc_id FROM documents), s AS (SELECT item, round(sum(1.0 / (rank + 60)), 9) AS score, min(list_no * 1000000000 + rank) AS seen FROM l GROUP BY 1) SELECT item, score, row_number() OVER (ORDER BY score DESC, seen) AS position FROM s",
    "feature_select": "WITH p AS (SELECT DISTINCT pair_id, coalesce(length(question), 0) AS a, coalesce(len(ground_truth), 0) AS b FROM correctness_classifier), l AS (SELECT 0 AS list_no, row_number() OVER (ORDER BY a DESC, pair_id) - 1 AS rank, pair_id AS item FROM p UNION ALL SELECT 1, row_number() OVER (ORDER BY b DESC, pair_id) - 1, pair_id FROM p), s AS (SELECT item, round(sum(1.0 / (rank + 60)), 9) AS score, min(list_no * 1000000000 + rank) AS seen FROM l GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, seen) AS k FROM s) SELECT item, score FROM r WHERE k <= (SELECT round_even(count(*) * 0.8, 0) FROM p)",
    "multi_query_dedup": _RES + ", x AS (SELECT query_id, content, (retrieval_type = 'sparse')::INT AS sub, pos FROM res), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY sub, pos) AS n FROM x) SELECT query_id, content, sub, pos FROM r WHERE n = 1",
    "rerank_topk": _RES + ", r AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, pos) AS rank FROM res WHERE retrieval_type = 'dense') SELECT * FROM r WHERE rank <= 3",
    "compress_rerank": _SENT + ", r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY item_id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER (PARTITION BY item_id) AS whole FROM sc) SELECT item_id, string_agg(text, '' ORDER BY pos) AS text FROM r WHERE before <= 0.6::DOUBLE * whole GROUP BY 1",
    "compress_cluster": _SENT + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id, label ORDER BY score, pos) AS low, count(*) OVER (PARTITION BY item_id, label) AS n FROM sc) SELECT item_id, string_agg(text, '' ORDER BY pos) AS text FROM r WHERE low > floor(n * 0.4) GROUP BY 1",
    "recall_quota": _RES + ", x AS (SELECT query_id AS item, (retrieval_type = 'sparse')::INT AS sub, pos * 2 + (retrieval_type = 'sparse')::INT AS pos, content FROM res), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, content ORDER BY pos) AS n FROM x) WHERE n = 1), q AS (SELECT item, sub, pos, content, 5 // m + CASE WHEN sub < 5 % m THEN 1 ELSE 0 END AS quota, row_number() OVER (PARTITION BY item, sub ORDER BY pos) AS own FROM (SELECT *, max(sub) OVER (PARTITION BY item) + 1 AS m FROM f)), e AS (SELECT item, sub, pos, content, (own > quota)::INT AS extra FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY extra, pos) AS place FROM e) SELECT item, sub, pos, content, extra FROM r WHERE place <= 5",
    "prefer_filter": r"WITH " + _MJ + r", s AS (SELECT mx_id, coalesce(try_cast(nullif(regexp_extract(j->>'dense_score', '(1(\.0{1,2})?|0(\.\d{1,2})?)', 1), '') AS DOUBLE), 0) AS score FROM m) SELECT * FROM s WHERE score >= 0.5",
    "score_to_similarity": "WITH " + _MJ + ", s AS (SELECT mx_id, try_cast(j->>'rerank_score' AS DOUBLE) AS x FROM m) SELECT mx_id, round(least(greatest(x, -5), 5) + 5, 6) AS similarity FROM s WHERE x IS NOT NULL AND NOT isnan(x)",
}
