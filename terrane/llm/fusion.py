"""One ranking from several differently-scaled scores: reciprocal rank fusion.

Every score ranks the items of a group on its own (equal values share the better rank), and an item's total is the sum
of 1 / (k + rank): the range of a score has no weight. A score that is absent, null, not a number or infinite ranks
behind all others of its group.

Ranks are taken without collecting a group: equal values are counted first (map-side combine), the counts are range
partitioned on (group, score, value), and each partition's running count starts at the sum of the ones before it. A
group with a third of all rows is spread over as many partitions as its size asks for.

Defined results: rows without a group take no part; groups of one item give one row; equal totals are ordered by id;
broken or empty metadata has no group; an empty table gives an empty ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.runtime import materialize

K = 60


def score_keys(scores: dict[str, str]) -> Column:
    """An array of (score, key) with the best key least; `scores` gives desc or asc per column of doubles."""
    out = []
    for name, order in scores.items():
        v = F.col(name)
        good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        out.append(F.struct(F.lit(name).alias("score"), F.when(good, (-v if order == "desc" else v) + F.lit(0.0)).otherwise(float("inf")).alias("key")))
    return F.array(*out)


def _placed(df: DataFrame, group: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """`before`: the sum of `weight` over the rows of the group that come first in `order`, which has no equals."""
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in group + order]).withColumn("part", F.spark_partition_id()), name)
    local = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and partition it reaches into
    offsets = ranged.groupBy(*group, "part").agg(F.sum(weight).alias("w")).select(*group, "part", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("offset"))
    placed = ranged.withColumn("local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    return placed.join(offsets, [*group, "part"]).withColumn("before", F.col("local") + F.col("offset")).drop("part", "local", "offset")


def fuse(items: DataFrame, group: str, item: str, scores: dict[str, str], k: int = K) -> DataFrame:
    """(group, item, total): the sum of reciprocal ranks."""
    long = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), F.explode(score_keys(scores)).alias("s")).select("g", "i", "s.score", "s.key")
    values = long.groupBy("g", "score", "key").agg(F.count(F.lit(1)).alias("n"))
    ranks = _placed(values, ["g", "score"], ["key"], "n", "ranks").select("g", "score", "key", (F.col("before") + 1).alias("rank"))
    return long.join(ranks, ["g", "score", "key"]).groupBy("g", "i").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 12).alias("total")).select(F.col("g").alias(group), F.col("i").alias(item), "total")


def top(fused: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The first n items of each group; every partition keeps n rows a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col("total").desc(), F.col(item))
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def positions(fused: DataFrame, group: str, item: str) -> DataFrame:
    """Every item with its position in the ranking of its group."""
    keyed = fused.select(F.col(group).alias("g"), F.col(item).alias("i"), (-F.col("total")).alias("key"), F.lit(1).alias("n"))
    placed = _placed(keyed, ["g"], ["key", "i"], "n", "positions")
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), (-F.col("key")).alias("total"), (F.col("before") + 1).alias("position"))
