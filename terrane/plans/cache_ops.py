"""Cache queries; the event stream is the access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import caching as C
from terrane.runtime import table


def _entries(s: SparkSession, d: str) -> DataFrame:
    return C.entries(table(s, d, "events"), "user_id", "ts")


def _answers(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "correctness_classifier").where("question is not null and answer is not null")
    return p.select(F.col("question").alias("query"), F.array_join("answer", " ").alias("answer"), "pair_id")


def _cache(s, d, part: int) -> DataFrame:
    a = _answers(s, d).where(F.col("pair_id") % 3 == part)
    return C.put(a.limit(0), a, "pair_id", 400)


def _asked(s, d):
    return table(s, d, "correctness_classifier").where("question is not null").select("pair_id", F.col("question").alias("query")).distinct()


def cache_exact(s, d):
    return C.lookup(_asked(s, d), [_cache(s, d, 0)]).select("pair_id", F.md5("answer").alias("answer"), "level")


def cache_cascade(s, d):
    return C.lookup(_asked(s, d), [_cache(s, d, 0), _cache(s, d, 1)]).select("pair_id", F.md5("answer").alias("answer"), "level")


def cache_semantic(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return C.semantic_lookup(v.where("id % 2 = 1").select(F.col("id").alias("query_id"), "vector"), v.where("id % 2 = 0"), 1, 0.35)


def evict_lru(s, d):
    return C.keep(_entries(s, d), "lru", 50).select("key", "last_access")


def evict_lfu(s, d):
    return C.keep(_entries(s, d), "lfu", 50).select("key", "hits")


def evict_fifo(s, d):
    return C.keep(_entries(s, d), "fifo", 50).select("key", "inserted_at")


def cache_replay(s, d):
    return C.replay(table(s, d, "events"), "event_type", "user_id", ["ts", "event_id"], 20)


def cache_similarity(s, d):
    p = table(s, d, "correctness_classifier").dropDuplicates(["pair_id"]).where("question is not null")
    q = p.select("pair_id", "question", F.when(F.col("pair_id") % 2 == 0, F.upper("question")).otherwise("x").alias("other"), (F.col("pair_id") % 7).cast("double").alias("score"))
    return q.select("pair_id", C.similarity(F.col("question"), F.col("other"), F.col("score"), 1.0, 5.0).alias("similarity"))


def _put(part: int) -> str:
    return f"c{part} AS (SELECT question AS query, arg_max(array_to_string(answer, ' '), pair_id) AS answer FROM correctness_classifier WHERE question IS NOT NULL AND answer IS NOT NULL AND pair_id % 3 = {part} AND length(array_to_string(answer, ' ')) < 400 GROUP BY 1)"


_ASK = "a AS (SELECT DISTINCT pair_id, question AS query FROM correctness_classifier WHERE question IS NOT NULL)"
_EN = "WITH k AS (SELECT user_id AS key, min(ts) AS inserted_at, max(ts) AS last_access, count(*) AS hits FROM events GROUP BY 1) "

SQL = {
    "cache_exact": f"WITH {_put(0)}, {_ASK} SELECT pair_id, md5(answer) AS answer, CASE WHEN answer IS NOT NULL THEN 0 END AS level FROM a LEFT JOIN c0 USING (query)",
    "cache_cascade": f"WITH {_put(0)}, {_put(1)}, {_ASK} SELECT pair_id, md5(coalesce(c0.answer, c1.answer)) AS answer, CASE WHEN c0.answer IS NOT NULL THEN 0 WHEN c1.answer IS NOT NULL THEN 1 END AS level FROM a LEFT JOIN c0 ON a.query = c0.query LEFT JOIN c1 ON a.query = c1.query",
    "cache_semantic": "WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.id AS query_id, x.id, list_cosine_similarity(q.v, x.v) AS c FROM x q JOIN x ON q.id % 2 = 1 AND x.id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS k FROM p) SELECT query_id, id, round(c, 6) AS similarity FROM r WHERE k = 1 AND round(c, 6) >= 0.35",
    "evict_lru": _EN + "SELECT key, last_access FROM k ORDER BY last_access DESC, key LIMIT 50",
    "evict_lfu": _EN + "SELECT key, hits FROM k ORDER BY hits DESC, last_access DESC, key LIMIT 50",
    "evict_fifo": _EN + "SELECT key, inserted_at FROM k ORDER BY inserted_at DESC, key LIMIT 50",
    "cache_replay": "WITH a AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), p AS (SELECT *, lag(i) OVER (PARTITION BY event_type, user_id ORDER BY i) AS last FROM a), h AS (SELECT event_type, i, last IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM a b WHERE b.event_type = p.event_type AND b.i > p.last AND b.i < p.i) < 20 AS hit FROM p) SELECT event_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, greatest(count(*) FILTER (NOT hit) - 20, 0) AS evictions FROM h GROUP BY 1",
    "cache_similarity": "SELECT DISTINCT pair_id, CASE WHEN lower(question) = lower(CASE WHEN pair_id % 2 = 0 THEN upper(question) ELSE 'x' END) THEN 4.0::DOUBLE ELSE least(greatest((pair_id % 7)::DOUBLE, 1), 5) - 1 END AS similarity FROM correctness_classifier WHERE question IS NOT NULL",
}
QUERIES = {k: globals()[k] for k in (*SQL, "cache_replay")}
