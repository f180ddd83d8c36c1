"""Dense, filtered, thresholded and sparse search over the embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import vectors as V
from terrane.runtime import table


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(s: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    v = F.transform(F.col("vector").cast("array<double>"), lambda x: x * 3) if scaled else F.col("vector")
    return _vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), v.alias("vector"))


def _top(metric: str, convention: str = "index", scaled: bool = True, k: int = 10):
    def run(s: SparkSession, d: str) -> DataFrame:
        found = V.knn(_queries(s, d, scaled), _vectors(s, d), k, metric, allow_self=False)
        raw = F.col("raw")
        if convention == "pg":
            raw = {"ip": -raw, "l2": F.sqrt(F.greatest(raw, F.lit(0.0))), "cosine": 1 - raw}[metric]
        return found.select("query_id", "id", "rank", F.round(V.scale_score(raw, metric, convention), 6).alias("score"))

    return run


def dense_lookup(s: SparkSession, d: str) -> DataFrame:
    """Retriever: top k, then the inner lookup in the chunk store drops ids without a chunk."""
    found = _top("ip", scaled=False)(s, d)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return found.join(docs, "id").select("query_id", "id", "rank", "score", "n_chars", F.lit("dense").alias("retrieval_type"))


def dense_filtered(s: SparkSession, d: str) -> DataFrame:
    """A filter on the document applies before the top k."""
    held = _vectors(s, d).where(F.col("label").isin(1, 3, 5))
    found = V.knn(_queries(s, d), held, 5, "cosine")
    return found.select("query_id", "id", "rank", F.round("raw", 6).alias("score"))


def dense_threshold(s: SparkSession, d: str) -> DataFrame:
    return V.above(_top("ip", scaled=False)(s, d), 0.3)


def normalize_vectors(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "dense_model").where("vector is not null and size(vector) = 64 and not exists(vector, x -> isnan(x))")
    return v.select("id", F.posexplode(V.normalize_l2(F.col("vector"))).alias("pos", "value")).select("id", "pos", (F.round("value", 6) + 0.0).alias("value"))


def sparse_topk(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hybrid_model").select("id", F.col("sparse_vector").alias("sparse"))
    q = h.where("id % 100 = 0").select(F.col("id").alias("query_id"), "sparse")
    return V.sparse_knn(q, h, 5)


def sparse_token_max(s: SparkSession, d: str) -> DataFrame:
    """Greatest positive weight per token over the chunks of a document."""
    t = table(s, d, "hybrid_model").where("document_id is not null").select(F.col("document_id").alias("id"), F.explode("sparse_vector").alias("t", "weight")).withColumn("token", F.col("t").cast("string"))
    return V.sparse_from_tokens(t).select("id", "token", F.round("weight", 6).alias("weight"))


def sparse_length(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hybrid_model").where("sparse_vector is not null")
    text = V.serialize_sparse(F.transform_values("sparse_vector", lambda k, v: F.round(v * 1000).cast("bigint")))
    return h.select("id", text.alias("text"))


_V = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"


def _sql(score: str, order: str, k: int, scale: int, where: str = "", self_: str = "q.id <> x.id", extra: str = "") -> str:
    return (
        f"WITH x AS ({_V}), q AS (SELECT id, list_transform(v, lambda e: e * {scale}) AS v FROM x WHERE id % 100 = 0), "
        f"s AS (SELECT q.id AS query_id, x.id, {score} AS score, {order} AS o FROM q JOIN x ON {self_} {where}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS rank FROM s) "
        f"SELECT query_id, id, rank, round(score, 6) AS score{extra} FROM r WHERE rank <= {k}"
    )


_IP, _L2, _COS = "list_inner_product(q.v, x.v)", "list_distance(q.v, x.v)", "list_cosine_similarity(q.v, x.v)"
_OIP, _OL2, _OCOS = f"-round({_IP}, 9)", f"round({_L2} * {_L2}, 9)", f"-round({_COS}, 9)"

QUERIES = {
    "dense_topk_ip": _top("ip"),
    "dense_topk_l2": _top("l2"),
    "dense_topk_cosine": _top("cosine"),
    "dense_topk_pg_ip": _top("ip", "pg"),
    "dense_topk_pg_l2": _top("l2", "pg"),
    "dense_topk_pg_cosine": _top("cosine", "pg"),
    "dense_lookup": dense_lookup,
    "dense_filtered": dense_filtered,
    "dense_threshold": dense_threshold,
    "normalize_vectors": normalize_vectors,
    "sparse_topk": sparse_topk,
    "sparse_token_max": sparse_token_max,
    "sparse_serialize": sparse_length,
}
SQL = {
    "dense_topk_ip": _sql(f"least({_IP}, 1)", _OIP, 10, 3),
    "dense_topk_l2": _sql(f"greatest(1 - {_L2} * {_L2} / 2, 0)", _OL2, 10, 3),
    "dense_topk_cosine": _sql(f"least({_COS}, 1)", _OCOS, 10, 3),
    "dense_topk_pg_ip": _sql(_IP, _OIP, 10, 3),
    "dense_topk_pg_l2": _sql(f"greatest(1 - {_L2} / 2, 0)", _OL2, 10, 3),
    "dense_topk_pg_cosine": _sql(f"greatest(1 - (1 - {_COS}) / 2, 0)", _OCOS, 10, 3),
    "dense_lookup": "WITH t AS (" + _sql(f"least({_IP}, 1)", _OIP, 10, 1) + ") SELECT t.query_id, t.id, t.rank, t.score, d.n_chars, 'dense' AS retrieval_type FROM t JOIN documents d ON d.doc_id = t.id",
    "dense_filtered": _sql(_COS, _OCOS, 5, 3, "WHERE x.label IN (1, 3, 5)", "true"),
    "dense_threshold": "SELECT * FROM (" + _sql(f"least({_IP}, 1)", _OIP, 10, 1) + ") WHERE score >= 0.3",
    "normalize_vectors": "WITH v AS (SELECT id, vector::DOUBLE[] AS v FROM dense_model WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0), n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM v) SELECT id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0::DOUBLE AS value FROM n",
    "sparse_topk": "WITH l AS (SELECT id, unnest(map_keys(sparse_vector)) AS idx, unnest(map_values(sparse_vector)) AS w FROM hybrid_model), s AS (SELECT q.id AS query_id, v.id, round(sum(q.w * v.w), 6) AS score FROM l q JOIN l v ON q.idx = v.idx WHERE q.id % 100 = 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 5",
    "sparse_token_max": "WITH l AS (SELECT document_id AS id, unnest(map_keys(sparse_vector))::VARCHAR AS token, unnest(map_values(sparse_vector)) AS w FROM hybrid_model WHERE document_id IS NOT NULL) SELECT id, token, round(max(w), 6) AS weight FROM l GROUP BY 1, 2 HAVING max(w) > 0",
    "sparse_serialize": "SELECT id, '{' || array_to_string(list_transform(list_sort(map_keys(sparse_vector)), lambda k: k || ':' || round(sparse_vector[k] * 1000)::BIGINT), ',') || '}/100000' AS text FROM hybrid_model WHERE sparse_vector IS NOT NULL",
}
