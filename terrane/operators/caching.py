"""Answer cache: lookup, levels and eviction."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.vectors import knn

MAX_LEVELS = 6
POLICIES = {"lru": ["last_access"], "lfu": ["hits", "last_access"], "fifo": ["inserted_at"], "rr": []}


def entries(log: DataFrame, key: str, at: str) -> DataFrame:
    """(key, inserted_at, last_access, hits) of an access log."""
    return log.groupBy(F.col(key).alias("key")).agg(F.min(at).alias("inserted_at"), F.max(at).alias("last_access"), F.count(F.lit(1)).alias("hits"))


def put(cache: DataFrame, new: DataFrame, order: str, limit: int) -> DataFrame:
    """Upsert of (query, answer): the last answer shorter than `limit` wins."""
    n = new.where(F.length("answer") < limit).withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.col(order).desc()))).where("_n = 1").select("query", "answer")
    return cache.select("query", "answer").join(n, "query", "left_anti").unionByName(n)


def lookup(queries: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(query, answer, level): the first level (query, answer) that holds the query; null on a miss."""
    if not 0 < len(levels) <= MAX_LEVELS:
        raise ValueError(f"between 1 and {MAX_LEVELS} levels")
    out = queries
    for i, c in enumerate(levels):
        out = out.join(c.select("query", F.col("answer").alias(f"_a{i}")), "query", "left")
    level = F.coalesce(*[F.when(F.col(f"_a{i}").isNotNull(), i) for i in range(len(levels))])
    return out.select(*queries.columns, F.coalesce(*[f"_a{i}" for i in range(len(levels))]).alias("answer"), level.alias("level"))


def semantic_lookup(queries: DataFrame, cache: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, id, similarity): the best of the k nearest entries, if its similarity reaches the threshold."""
    found = knn(queries, cache, k, "cosine").where("rank = 1").select("query_id", "id", F.round("raw", 6).alias("similarity"))
    return found.where(F.col("similarity") >= threshold)


def similarity(a: Column, b: Column, score: Column, lo: float, hi: float, reverse: bool = False) -> Column:
    """Equal texts regardless of case have the greatest similarity, others the clamped score shifted to start at 0."""
    s = F.when(F.lower(a) == F.lower(b), F.lit(hi - lo)).otherwise(F.least(F.greatest(score, F.lit(lo)), F.lit(hi)) - lo)
    return (hi - lo) - s if reverse else s


def keep(entries_: DataFrame, policy: str, size: int, seed: int = 0) -> DataFrame:
    """The entries a full cache holds on to: a bounded top-n, without a global sort. `rr` keeps them at random, by a hash of
    key and seed."""
    order = [F.xxhash64("key", F.lit(seed))] if policy == "rr" else [F.col(c).desc() for c in POLICIES[policy]]
    return entries_.orderBy(*order, "key").limit(size)


def replay(log: DataFrame, shard: str, key: str, order: list[str], size: int) -> DataFrame:
    """(shard, hits, misses, evictions) of an LRU cache per shard, access by access. The accesses of a shard arrive sorted, in
    batches; only its cache of `size` keys is held. Null shards are one shard."""
    kind = dict(log.dtypes)[shard]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, counts = None, OrderedDict(), [0, 0, 0]
        out: list[tuple] = []
        for b in batches:
            for s, null, k in zip(b[shard], b[shard].isna(), b[key]):
                s = None if null else s
                if current is None or s != current[0]:
                    out += [(current[0], *counts)] if current else []
                    current, held, counts = (s,), OrderedDict(), [0, 0, 0]
                if k in held:
                    held.move_to_end(k)
                    counts[0] += 1
                else:
                    counts[1] += 1
                    held[k] = None
                    if len(held) > size:
                        held.popitem(last=False)
                        counts[2] += 1
        out += [(current[0], *counts)] if current else []
        yield pd.DataFrame(out, columns=[shard, "hits", "misses", "evictions"])

    sorted_ = log.select(shard, key, *order).repartition(shard).sortWithinPartitions(shard, *order)
    return sorted_.mapInPandas(run, f"{shard} {kind}, hits bigint, misses bigint, evictions bigint")
