"""Retrieval over a graph: nodes by vector and concept, contexts around them, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.graph import bfs_tree
from terrane.operators.ranking import first_seen
from terrane.operators.vectors import knn


def search_text_nodes(queries: DataFrame, vectors: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): of the k nearest nodes those that are text nodes (texts: id), so fewer than k may come back."""
    return knn(queries, vectors, k).join(texts.select("id").distinct(), "id", "left_semi").select("query_id", "id", "rank")


def retrieve_nodes(queries: DataFrame, vectors: DataFrame, k: int, concepts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank): the k nearest nodes; with a concept store (id: the node a concept stands for, vector) nodes and
    concepts are searched for k each, and the k found most often come out, the earlier first where equal."""
    found = knn(queries, vectors, k).select("query_id", "id", F.col("rank").alias("at"))
    if concepts is not None:
        found = found.unionByName(knn(queries, concepts, k).select("query_id", "id", (F.col("rank") + k).alias("at")))
    votes = found.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy(F.col("n").desc(), "at")
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank")


def gather(entities: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, id, pos): the nodes of a question's entities (question_id, pos, entity) in order, once each; found is
    (query_id = entity, id, rank)."""
    x = entities.join(found.withColumnRenamed("query_id", "entity"), "entity").select("question_id", "id", F.struct("pos", "rank").alias("at"))
    first = first_seen(x, ["question_id", "id"], ["at"])
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy("at"))).select("question_id", "id", "pos")


def question_contexts(nodes: DataFrame, edges: DataFrame, depth: int, limit: int, texts: bool = False) -> DataFrame:
    """(question_id, pos, context): the edges that lead to new nodes within `depth` hops of a question's nodes, nearest
    first, at most `limit`; with `texts` the passages they conclude, once each."""
    seeds = nodes.select(F.col("question_id").alias("seed"), F.col("id").alias("node"))
    tree = bfs_tree(seeds, edges, depth).join(edges.select("src", "dst", "relation"), ["src", "dst"])
    if texts:
        t = tree.where("relation = 'text_conclude'").select("seed", "depth", "src", "dst", F.col("dst").alias("context"))
        tree = first_seen(t, ["seed", "context"], ["depth", "src", "dst"])
    else:
        tree = tree.withColumn("context", F.concat_ws(" ", "src", "relation", "dst"))
    w = Window.partitionBy("seed").orderBy("depth", "src", "dst")
    return tree.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select(F.col("seed").alias("question_id"), "pos", "context")


def graph_answers(questions: DataFrame, contexts: DataFrame, template: str, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(question_id, question, contexts, result): questions (question_id, question) with their contexts put into a template
    of {context} and {question}; without a model only the contexts are retrieved."""
    c = contexts.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "context"))), lambda x: x["context"]).alias("contexts"))
    q = questions.join(c, "question_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    prompt = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.array_join("contexts", "\n")), F.lit("{question}"), F.col("question"))
    return q.select("question_id", "question", "contexts", (generate(prompt) if generate else F.lit(None).cast("string")).alias("result"))
