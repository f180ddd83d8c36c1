"""Rerank, fusion and selection: every order has a position as its last key, because Spark's sort is not stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.runtime import materialize

# The weight curve of hybrid ranking.
BASELINE, AMPLITUDE, SLOPE, MIDPOINT = 0.4, 0.3, 1.0, 6.0


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in a total order, without a task that sees them all: rows are range partitioned, and each
    partition counts on from the rows of those before it."""
    part = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + local).drop("_part", "_offset")


def top_k(df: DataFrame, keys: list[str], score: str, pos: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), pos)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def min_max(score: str, keys: list[str]) -> Column:
    """(s - min) / (max - min) within the keys; equal scores are all 0; a missing score counts as 0."""
    w = Window.partitionBy(*keys)
    s = F.coalesce(F.col(score), F.lit(0.0))
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    return F.when(hi == lo, F.lit(0.0)).otherwise((s - lo) / (hi - lo))


def dense_weight(query: Column) -> Column:
    """Grows with the characters of the query from 0.4 to 0.7."""
    return BASELINE + AMPLITUDE / (1 + F.exp(-SLOPE * (F.length(query) - MIDPOINT)))


def hybrid(results: DataFrame, k: int) -> DataFrame:
    """(query_id, content, score, retrieval_type, rank) from (query_id, query, content, score, retrieval_type, pos).

    Scores are normalised within query and type; of equal contents in one type the last wins; a content found by one
    type only has 0 on the other side; one found by both gets the type both.
    """
    n = results.withColumn("s", min_max("score", ["query_id", "retrieval_type"])).withColumn("w", dense_weight(F.col("query")))
    side = lambda kind, name: n.where(F.col("retrieval_type") == kind).groupBy("query_id", "content").agg(F.max_by("s", "pos").alias(name), F.min("pos").alias(f"pos_{name}"), F.max("w").alias(f"w_{name}"))
    both = side("dense", "d").join(side("sparse", "s"), ["query_id", "content"], "full")
    w = F.coalesce("w_d", "w_s")
    kind = F.when(F.col("d").isNull(), "sparse").when(F.col("s").isNull(), "dense").otherwise("both")
    out = both.select("query_id", "content", F.round(w * F.coalesce("d", F.lit(0.0)) + (1 - w) * F.coalesce("s", F.lit(0.0)), 6).alias("score"), kind.alias("retrieval_type"))
    return top_k(out, ["query_id"], "score", "content", k)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(item, score, position) from (list_no, rank, item) with ranks from 0: the sum of 1 / (rank + k), in the order of
    score, then first appearance."""
    s = lists.groupBy("item").agg(F.round(F.sum(1 / (F.col("rank") + k)), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    return numbered(s, [F.col("score").desc(), F.col("seen")], "position").select("item", "score", "position")


def keep_best(df: DataFrame, score: str, share: float, pos: str) -> DataFrame:
    """The first round(n * share) rows by score; round is half to even."""
    n = df.agg(F.bround(F.count(F.lit(1)) * F.lit(share)).alias("n"))
    ranked = numbered(df, [F.col(score).desc(), F.col(pos)], "rank")
    return ranked.join(F.broadcast(n)).where("rank <= n").drop("n")


def first_seen(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the order."""
    o = [F.col(c).desc() if last else F.col(c) for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*o))).where("_n = 1").drop("_n")


def compress_by_score(sentences: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Sentences (keys, pos, text, score) taken by score until their length passes rate times the whole; the sentence
    that crosses is kept. Returns keys, text joined in the original order."""
    w = Window.partitionBy(*keys)
    run = w.orderBy(F.col("score").desc(), "pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = sentences.withColumn("before", F.coalesce(F.sum(F.length("text")).over(run), F.lit(0))).withColumn("whole", F.sum(F.length("text")).over(w)).where(F.col("before") <= F.lit(rate) * F.col("whole"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    return kept.groupBy(*keys).agg(joined.alias("text"))


def compress_by_cluster(sentences: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Of every cluster (column label) the floor(n * rate) least similar sentences are dropped."""
    w = Window.partitionBy(*keys, "label")
    kept = sentences.withColumn("low", F.row_number().over(w.orderBy("similarity", "pos"))).withColumn("n", F.count(F.lit(1)).over(w)).where("low > floor(n * %s)" % rate)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    return kept.groupBy(*keys).agg(joined.alias("text"))


def recall_quota(docs: DataFrame, n: int) -> DataFrame:
    """n documents of (item, sub, pos, content): distinct contents first-seen, each sub-query gets n // m (the first n % m
    one more), the rest is filled in the original order."""
    d = first_seen(docs, ["item", "content"], ["pos"])
    m = F.max("sub").over(Window.partitionBy("item")) + 1
    d = d.withColumn("m", m).withColumn("quota", F.expr(f"{n} div m") + F.when(F.col("sub") < F.expr(f"{n} % m"), 1).otherwise(0))
    d = d.withColumn("own", F.row_number().over(Window.partitionBy("item", "sub").orderBy("pos")))
    d = d.withColumn("extra", (F.col("own") > F.col("quota")).cast("int"))
    ranked = d.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy("extra", "pos")))
    return ranked.where(F.col("place") <= n).select("item", "sub", "pos", "content", "extra")
