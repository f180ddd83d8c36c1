import numpy as np
from pyspark.sql import functions as F

from terrane.llm.neighbours import neighbours, rotation, scan


def exact(ids, v, k):
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(n @ n.T, 9)
    np.fill_diagonal(s, -9)
    return {(i, ids[j]) for a, i in enumerate(ids) for j in np.lexsort((ids, -s[a]))[:k]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>, rank string, list string, part string")


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 64))
    v = (base[r.integers(0, 60, 3000)] + 0.8 * r.standard_normal((3000, 64))).astype(np.float32)
    df = frame(spark, [(i, x.tolist(), "a", "b", "c") for i, x in enumerate(v)])
    got = {(x.id, x.neighbour_id) for x in neighbours(df, 10).collect()}
    want = exact(np.arange(3000), v.astype(float), 10)
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9
    full = {(x.id, x.neighbour_id) for x in neighbours(df, 10, asked=F.col("id") % 30 == 0, probes=10_000).collect()}
    own = {p for p in want if p[0] % 30 == 0}
    assert len(full & own) / len(own) >= 0.99


def test_invalid_vectors_ties_and_empty_tables(spark):
    e = [0.0] * 64
    one, two = e[:], e[:]
    one[0], two[1] = 1.0, 1.0
    nan = e[:]
    nan[3] = float("nan")
    rows = [(1, one), (2, [x * 5 for x in one]), (3, one), (4, two), (5, None), (6, e), (7, nan), (8, [1.0] * 63), (None, one)]
    got = neighbours(frame(spark, [(*x, "", "", "") for x in rows]), 2).orderBy("id", "rank").collect()
    assert [(x.id, x.neighbour_id) for x in got] == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2)]
    assert neighbours(frame(spark, []), 3).count() == 0


def test_scan_keeps_the_nearest():
    r = np.random.default_rng(0)
    v = r.standard_normal((800, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    i, j = scan(v[:50], v, 10, rotation(64))
    kept = set(zip(i.tolist(), j.tolist()))
    best = np.argsort(-(v[:50] @ v.T), axis=1)[:, :10]
    want = {(a, int(b)) for a in range(50) for b in best[a]}
    assert len(want & kept) / len(want) >= 0.98 and len(kept) < 50 * 15
