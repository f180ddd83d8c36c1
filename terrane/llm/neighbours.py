"""Most similar vectors for every vector: an adaptive dimension scan of probed lists.

Unit vectors are assigned to the lists of centroids fitted on a bounded sample (SAMPLE vectors, or PER_LIST a list up to
SAMPLE_MOST); the number of lists grows with the root of the number of vectors, up to a list for PER_LIST of the largest
sample. A query probes PROBES lists. Within a list the vectors lie, rotated by a
fixed random orthogonal matrix, in blocks of columns; after each block of columns a hypothesis test compares the
partial squared distance, scaled to all dimensions, with the query's k-th best distance so far, and candidates that
cannot reach it at the set significance are abandoned. The rest is compared exactly in double precision.

Lists are cut into blocks of BLOCK vectors and the queries that probe a list, which are counted first, into parts, so a
list with a third of all vectors or probes is spread over as many tasks as its size asks for. Every block returns k rows a query.

Defined results: vectors that are null, of another length, all zero or not finite take no part on either side; a vector
is no neighbour of itself; equal similarities (to 9 decimals) are ordered by id; fewer than k others give fewer rows;
equal vectors are neighbours of each other; an empty table gives no rows. Rows without an id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.runtime import materialize, spread

SAMPLE, PER_LIST, SAMPLE_MOST, ITERATIONS = 16_384, 8, 262_144, 8
#: Least number of lists a query probes, and the share of the root of all lists it grows to.
PROBES, PROBE_SHARE = 12, 0.9
BLOCK = 4096
#: Columns scanned before each test, and the significance of a test (larger abandons less).
COLUMNS, EPSILON = 16, 2.1
_LISTED = "list int, part int, id bigint, vector binary"


def rotation(dims: int) -> np.ndarray:
    """The same random orthogonal matrix everywhere."""
    return np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))[0].astype(np.float32)


def _valid(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors)."""
    lengths = np.diff(column.offsets.to_numpy())
    ok = np.asarray(column.is_valid()) & (lengths == dims)
    flat = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()[:-1][ok]
    v = flat[at[:, None] + np.arange(dims)].astype(np.float32) if len(at) else np.zeros((0, dims), np.float32)
    good = np.isfinite(v).all(1) & (np.abs(v).max(1, initial=0) > 0)
    return np.flatnonzero(ok)[good], v[good]


def _unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[s : s + 2048] @ c.T).argmax(1) for s in range(0, len(x), 2048)] or [np.zeros(0, np.int64)])


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(5)
    x = _unit(sample).astype(np.float32)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ITERATIONS):
        near = _closest(x, c)
        total = np.zeros_like(c, np.float64)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-12)[:, None], x[rng.choice(len(x), lists)]).astype(np.float32)
    return c


def _assign(shared, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            rows, v = _valid(b.column(1), dims)
            ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
            near = _closest(_unit(v).astype(np.float32), c)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], ["list", "part", "id", "vector"])

    return run


def _probed(v: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The lists each vector probes."""
    parts = [np.argpartition(-(_unit(v[s : s + 2048]).astype(np.float32) @ c.T), min(probes, len(c)) - 1, axis=1)[:, :probes] for s in range(0, len(v), 2048)]
    return np.concatenate(parts or [np.zeros((0, 1), np.int64)])


def _count_probes(shared, dims: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros(len(c), np.int64)
        for b in batches:
            v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, dims)
            total += np.bincount(_probed(v, c, probes).ravel(), minlength=len(c))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["list", "n"])

    return run


def _split(shared, dims: int, asked: bool, probes: int):
    """Rows for the blocks of the lists: a vector goes to its block, once for every part of the list's queries; a query
    to every block of the lists it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, blocks, parts = shared.value
        for b in batches:
            near, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            if asked:
                v = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float32).reshape(-1, dims)
                near = _probed(v, c, probes)
                row = np.repeat(np.arange(len(ids)), near.shape[1])
                near = near.ravel()
            else:
                row = np.arange(len(ids))
            mixed = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            mine, other = (parts, blocks) if asked else (blocks, parts)
            own = (mixed % mine[near].astype(np.uint64)).astype(np.int64)
            times = other[near]
            row, near, own = np.repeat(row, times), np.repeat(near, times), np.repeat(own, times)
            far = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            block, part = (far, own) if asked else (own, far)
            where = block * parts[near] + part
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(where.astype(np.int32)), pa.array(ids[row], pa.int64()), b.column(3).take(pa.array(row))], ["list", "part", "id", "vector"])

    return run


def scan(q: np.ndarray, v: np.ndarray, k: int, turn: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of unit rows that survive all tests; the k nearest of each query are among them but for the
    chance the tests allow. `turn` rotates both."""
    dims = q.shape[1]
    x, y = q @ turn, v @ turn
    part = (x[:, :columns] ** 2).sum(1)[:, None] + (y[:, :columns] ** 2).sum(1)[None, :] - 2 * x[:, :columns] @ y[:, :columns].T
    m = min(k, len(v))
    first = np.argpartition(part, m - 1, axis=1)[:, :m] if m < len(v) else np.tile(np.arange(len(v)), (len(q), 1))
    # the k-th best so far: the whole distance of the k that lead after the first columns
    bar = (2 - 2 * np.einsum("id,ijd->ij", x, y[first])).max(1) + 1e-6
    keep = part <= (bar * (columns / dims) * (1 + epsilon / math.sqrt(columns)) ** 2)[:, None]
    np.put_along_axis(keep, first, True, 1)
    i, j = np.nonzero(keep)
    d, seen = part[i, j], columns
    while seen < dims and len(i):
        step = slice(seen, min(dims, seen + columns))
        d = d + ((x[i, step] - y[j, step]) ** 2).sum(1)
        seen = step.stop
        if seen < dims:
            at, lead = _leaders(i, d, m)
            full = 2 - 2 * np.einsum("nd,nd->n", x[i[lead]], y[j[lead]])
            enough = np.diff(np.append(at, len(lead))) >= m
            bar[i[lead[at[enough]]]] = np.minimum(bar[i[lead[at[enough]]]], np.maximum.reduceat(full, at)[enough] + 1e-6)
            limit = bar[i] * (seen / dims) * (1 + epsilon / math.sqrt(seen)) ** 2
        else:
            limit = bar[i]
        ok = d <= limit + 1e-6
        i, j, d = i[ok], j[ok], d[ok]
    if not len(i):
        return i, j
    at, lead = _leaders(i, d, m)
    worst = np.full(len(q), -1.0, np.float32)
    worst[i[lead[at]]] = np.maximum.reduceat(d[lead], at)
    ok = d <= worst[i] + 1e-5
    return i[ok], j[ok]


def _leaders(i: np.ndarray, d: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m rows of least d of every i, in order of i, and where each i begins among them."""
    o = np.lexsort((d, i))
    head = np.flatnonzero(np.concatenate([[True], np.diff(i[o]) != 0]))
    place = np.arange(len(o)) - np.repeat(head, np.diff(np.append(head, len(o))))
    lead = o[place < m]
    return np.flatnonzero(np.concatenate([[True], np.diff(i[lead]) != 0])), lead


def _nearest(k: int, dims: int):
    turn = rotation(dims)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, asked = left.column("id").to_numpy(), right.column("id").to_numpy()
            v = _unit(np.frombuffer(b"".join(left.column("vector").to_pylist()), np.float32).reshape(-1, dims))
            q = _unit(np.frombuffer(b"".join(right.column("vector").to_pylist()), np.float32).reshape(-1, dims))
            v32 = v.astype(np.float32)
            for s in range(0, len(q), 512):
                # one more: the vector itself may be among them
                i, j = scan(q[s : s + 512].astype(np.float32), v32, k + 1, turn)
                i = i + s
                other = asked[i] != ids[j]
                i, j = i[other], j[other]
                cos = np.round(np.einsum("nd,nd->n", q[i], v[j]), 9)
                o = np.lexsort((ids[j], -cos, i))
                i, j, cos = i[o], j[o], cos[o]
                head = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
                place = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i))))
                top = place < k
                for x, y in zip(out, (asked[i[top]], ids[j[top]], cos[top])):
                    x.append(y)
        cat = lambda n, t: pa.array(np.concatenate(out[n]) if out[n] else [], t)
        return pa.table({"id": cat(0, pa.int64()), "neighbour_id": cat(1, pa.int64()), "similarity": cat(2, pa.float64())})

    return run


def neighbours(vectors: DataFrame, k: int = 10, asked: Column | None = None, dims: int = 64, probes: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, neighbour_id, rank, similarity): the k most similar other rows of every row, or of the rows `asked` picks by id.

    `probes` trades accuracy for time; with as many probes as there are lists the scan covers everything. By default it
    grows with the root of the number of lists, which keeps the accuracy as the collection grows.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("id is not null and size(vector) = " + str(dims))
    n = slim.count()
    lists = max(1, min(round(math.sqrt(n)), SAMPLE_MOST // PER_LIST))
    size = max(SAMPLE, PER_LIST * lists)
    sample = slim.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(min(1 << 40, (size << 40) // max(n, 1)))).limit(size + size // 10)
    fit = _valid(pa.array([r[0] for r in sample.select("vector").collect()], pa.list_(pa.float32())), dims)[1]
    if not len(fit):  # a small or wholly invalid sample: any vectors will do
        some = slim.where(F.forall("vector", lambda x: ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)).limit(size)
        fit = _valid(pa.array([r[0] for r in some.select("vector").collect()], pa.list_(pa.float32())), dims)[1]
    if not len(fit):
        return spark.createDataFrame([], "id bigint, neighbour_id bigint, rank int, similarity double")
    c = centroids(fit, lists)
    probes = min(len(c), probes or max(PROBES, math.ceil(PROBE_SHARE * math.sqrt(len(c)))))
    known = spark.sparkContext.broadcast(c)
    listed = materialize(spread(slim, "id").mapInArrow(_assign(known, dims), _LISTED), "listed")
    # one row a list
    queries = listed if asked is None else listed.where(asked)
    counts = dict(listed.groupBy("list").count().collect())
    wanted = dict(queries.select("vector").mapInArrow(_count_probes(known, dims, probes), "list int, n bigint").groupBy("list").agg(F.sum("n")).collect())
    blocks = np.array([max(1, -(-counts.get(i, 0) // BLOCK)) for i in range(len(c))])
    parts = np.array([max(1, -(-wanted.get(i, 0) // (4 * BLOCK))) for i in range(len(c))])
    shared = spark.sparkContext.broadcast((c, blocks, parts))

    held = listed.mapInArrow(_split(shared, dims, False, probes), _LISTED).groupBy("list", "part")
    sent = queries.mapInArrow(_split(shared, dims, True, probes), _LISTED).groupBy("list", "part")
    found = held.cogroup(sent).applyInArrow(_nearest(k, dims), "id bigint, neighbour_id bigint, similarity double")
    w = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour_id")
    return found.dropDuplicates(["id", "neighbour_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "neighbour_id", "rank", "similarity")
