"""Training and evaluation data for retrieval models: pairs, features, preference, rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import parse_score
from terrane.operators.curation import qd_pairs, question_lines, rewrites
from terrane.operators.ranking import keep_best, numbered, rrf
from terrane.runtime import materialize


def coarse_pairs(docs: DataFrame, ask: Callable[[Column], Column]) -> DataFrame:
    """(pair_id, doc_id, query, content): the questions a model asks about each document (doc_id, content), once each."""
    asked = docs.where("content is not null and trim(content) <> ''").withColumn("_questions", question_lines(ask(F.col("content"))))
    pairs = qd_pairs(asked, F.col("_questions"))
    return numbered(pairs, [F.col("doc_id"), F.col("pos")], "pair_id").join(docs.select("doc_id", "content"), "doc_id").select("pair_id", "doc_id", "query", "content")


def featured(pairs: DataFrame, scores: list[Callable[[Column, Column], Column]], share: float = 0.8) -> DataFrame:
    """The best `share` of the pairs by the fused ranks of several scores of query and content."""
    scored = materialize(pairs.select("pair_id", *[f(F.col("query"), F.col("content")).alias(f"_s{i}") for i, f in enumerate(scores)]), "scores")
    lists = None
    for i in range(len(scores)):
        one = numbered(scored, [F.col(f"_s{i}").desc_nulls_last(), F.col("pair_id")]).select(F.lit(i).alias("list_no"), (F.col("number") - 1).alias("rank"), F.col("pair_id").alias("item"))
        lists = one if lists is None else lists.unionByName(one)
    return keep_best(rrf(lists), "score", share, "position").select(F.col("item").alias("pair_id")).join(pairs, "pair_id")


def preferred(pairs: DataFrame, judge: Callable[[Column, Column], Column], threshold: float = 0.8) -> DataFrame:
    """Pairs whose score in a model's answer reaches the threshold, with that score."""
    return pairs.withColumn("score", parse_score(judge(F.col("query"), F.col("content")))).where(F.col("score") >= threshold)


def train_data(docs: DataFrame, ask: Callable[[Column], Column], scores: list, judge: Callable, rewrite: Callable[[Column, Column], Column], share: float = 0.8, threshold: float = 0.8, times: int = 2) -> DataFrame:
    """(query, corpus, rewrite_no): coarse pairs, the featured share, the preferred ones, each with its rewrites."""
    kept = preferred(featured(materialize(coarse_pairs(docs, ask), "pairs"), scores, share), judge, threshold)
    return rewrites(kept, times, rewrite).select("query", F.col("content").alias("corpus"), "rewrite_no")


def evaluation_data(docs: DataFrame, ask: Callable[[Column], Column]) -> DataFrame:
    """(query, corpus) of the coarse pairs."""
    return coarse_pairs(docs, ask).select("query", F.col("content").alias("corpus"))
