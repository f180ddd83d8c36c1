"""Vector arithmetic, score conventions and exact k-nearest search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries are broadcast in blocks of this many; more of them are more scans, not more memory.
QUERY_BLOCK = 32_768
METRICS = ("ip", "l2", "cosine")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalize_l2(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def scale_score(raw: Column, metric: str, convention: str = "index") -> Column:
    """The store's similarity from the raw distance or product. `index`: ip and cosine capped at 1, squared L2 to
    1 - x / 2 floored at 0. `pg`: raw is the database operator's value (negative product, L2, cosine distance)."""
    if metric not in METRICS or convention not in ("index", "pg"):
        raise ValueError(f"unknown metric or convention: {metric}, {convention}")
    if convention == "pg":
        return -raw if metric == "ip" else F.greatest(1 - raw / 2, F.lit(0.0))
    return F.greatest(1 - raw / 2, F.lit(0.0)) if metric == "l2" else F.least(raw, F.lit(1.0))


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that length, their vectors)."""
    at = column.offsets.to_numpy()
    ok = np.flatnonzero(np.diff(at) == dims)
    flat = column.values.to_numpy(zero_copy_only=False)
    return ok, flat[at[:-1][ok][:, None] + np.arange(dims)].astype(np.float64) if len(ok) else np.zeros((0, dims))


def _scan(shared, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        qn = np.linalg.norm(q, axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            ok, v = _matrix(b.column(1), q.shape[1])
            if not len(ok):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)[ok]
            for s in range(0, len(q), 1024):
                raw = q[s : s + 1024] @ v.T
                if metric == "cosine":
                    raw = raw / np.maximum(qn[s : s + 1024, None] * np.linalg.norm(v, axis=1)[None, :], 1e-300)
                if metric == "l2":
                    raw = qn[s : s + 1024, None] ** 2 + (v**2).sum(1)[None, :] - 2 * raw
                key = np.round(raw if metric == "l2" else -raw, 9)
                # everything as good as the k-th, so that ties are decided by id later
                edge = np.partition(key, k - 1, axis=1)[:, k - 1] if key.shape[1] > k else np.full(len(key), np.inf)
                i, j = np.nonzero(key <= edge[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qid[s + i]), pa.array(ids[j]), pa.array(raw[i, j])], ["query_id", "id", "raw"])

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int = 3, metric: str = "ip", allow_self: bool = True) -> DataFrame:
    """(query_id, id, raw, rank) of the k best of `vectors` (id, vector) for each of `queries` (query_id, vector), exactly.

    Every Arrow batch of vectors is multiplied with a broadcast block of queries and keeps k rows a query (and ties);
    only these are shuffled. Filters on `vectors` apply before the top k. Equal scores are ordered by id. The length is
    that of most queries; null vectors and those of another length take no part on either side.
    """
    if not 0 < k <= 10_000:
        raise ValueError("k must be between 1 and 10000")
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark = vectors.sparkSession
    rows = queries.select("query_id", "vector").where("vector is not null")
    lengths = dict(rows.groupBy(F.size("vector")).count().collect())  # one row a length
    dims = max(lengths, key=lambda k: (lengths[k], k)) if lengths else 0
    rows = rows.where(F.size("vector") == dims)
    parts, blocks = [], max(1, -(-lengths.get(dims, 0) // QUERY_BLOCK))
    held = vectors.select("id", "vector").where("vector is not null")
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        got = part.collect()
        if got:
            shared = spark.sparkContext.broadcast((np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)))
            parts.append(held.mapInArrow(_scan(shared, k + (not allow_self), metric), "query_id bigint, id bigint, raw double"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, id bigint, raw double, rank int")
    found = reduce(DataFrame.unionByName, parts)
    if not allow_self:
        found = found.where("query_id <> id")
    order = F.round("raw", 9) if metric == "l2" else -F.round("raw", 9)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= k)


def above(found: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Threshold search: applied after the top k, so rows beyond k never return."""
    return found.where(F.col(score) >= threshold)


def sparse_knn(queries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, id, score, rank) by inner product of maps: both sides in long form, joined on the index."""
    q = queries.select("query_id", F.explode("sparse").alias("idx", "qw"))
    v = vectors.select("id", F.explode("sparse").alias("idx", "vw"))
    scored = v.join(q, "idx").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * F.col("vw")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_from_tokens(weights: DataFrame, special: tuple[str, ...] = ("[CLS]", "[SEP]", "[EOS]", "[PAD]", "[UNK]")) -> DataFrame:
    """(id, token, weight): the greatest positive weight of each token, without special tokens."""
    return weights.where(~F.col("token").isin(*special)).groupBy("id", "token").agg(F.max("weight").alias("weight")).where("weight > 0")


def serialize_sparse(m: Column, dims: int = 100_000) -> Column:
    """{k:v,...}/dims with keys ascending."""
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit(f"}}/{dims}"))
