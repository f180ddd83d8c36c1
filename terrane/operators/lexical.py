"""Tokens, postings and BM25 in its store and Okapi variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.runtime import materialize

STORE = {"k1": 1.2, "b": 0.75}
OKAPI = {"k1": 1.5, "b": 0.75}


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; every Han character is a token of its own."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(\p{IsHan})", " $1 "), F.lit(r"([\p{L}\p{N}]+)"), 1)


def comma_tokens(text: Column) -> Column:
    """Pieces between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")


def postings(docs: DataFrame, tokens: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf, dl)."""
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("tokens"))
    return t.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n, avgdl."""
    return docs.select(F.size(tokens).alias("dl")).where("dl >= 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _tf_part(k1: float, b: float) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25_store(queries: DataFrame, docs: DataFrame, tokens: Column, k: int, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of docs (doc_id, ...) for each of queries (query_id, term), each term
    counted once a query. A filter, `allowed` (doc_id), narrows the candidates; lengths and frequencies are those of the
    whole corpus. The corpus is tokenised once: tokens of no query are dropped before they are grouped, and a row without a
    term carries the length of every document."""
    terms = queries.select("query_id", "term").distinct()
    t = docs.select("doc_id", tokens.alias("tokens")).where("tokens is not null")
    t = t.select("doc_id", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    t = t.join(terms.select("term").distinct().withColumn("wanted", F.lit(True)), "term", "left").where("wanted or term is null")
    t = materialize(t.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")), "postings")
    stats = t.where("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    needed = t.where("term is not null")
    df = needed.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if allowed is not None:
        needed = needed.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    weight = needed.join(df, "term").join(F.broadcast(stats)).select("term", "doc_id", (idf * _tf_part(k1, b)).alias("w"))
    scored = weight.join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 5).alias("score"))
    win = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)


def okapi_idf(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, idf): ln((n - df + .5) / (df + .5)), negative ones replaced by a quarter of the mean."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    return df.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_pairs(queries: DataFrame, post: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): Okapi score of each query with its own document; queries are (query_id, doc_id, term),
    every occurrence of a term adds its score, a pair without shared terms scores 0."""
    asked = queries.groupBy("query_id", "doc_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hit = asked.join(post, ["doc_id", "term"]).join(okapi_idf(post, stats), "term").join(F.broadcast(stats))
    scored = hit.groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * F.col("idf") * _tf_part(k1, b)).alias("s"))
    pairs = queries.select("query_id", "doc_id").distinct()
    return pairs.join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.coalesce("s", F.lit(0.0)), 5).alias("score"))
