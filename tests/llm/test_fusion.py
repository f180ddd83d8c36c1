import random

from terrane.llm.fusion import fuse, positions, top

SCORES = {"a": "desc", "b": "asc"}


def brute(rows, k=60):
    out = {}
    groups = {}
    for g, i, a, b in rows:
        if g is not None and i is not None:
            groups.setdefault(g, []).append((i, a, b))
    inf = float("inf")
    for g, items in groups.items():
        ka = {i: -a if a is not None and a == a and abs(a) < inf else inf for i, a, _ in items}
        kb = {i: b if b is not None and b == b and abs(b) < inf else inf for i, _, b in items}
        for i in ka:
            out[g, i] = sum(1 / (k + 1 + sum(v < key[i] for v in key.values())) for key in (ka, kb))
    return out


def test_equals_brute_force_with_ties_and_missing_scores(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, 3]), n, r.choice([None, float("nan"), 1.0, 2.0, r.random()]), r.choice([None, float("inf"), 5.0, r.random() * 1e6])) for n in range(400)]
    rows += [(None, 900, 1.0, 1.0), (4, None, 1.0, 1.0), (9, 901, None, None)]
    df = spark.createDataFrame([(*x, "x", "y", "z") for x in rows], "q long, m long, a double, b double, g string, i string, key string")
    got = {(x.q, x.m): x.total for x in fuse(df, "q", "m", SCORES).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_positions_are_whole_and_top_is_their_head(spark):
    df = spark.createDataFrame([(1, n, float(n % 7), float(n)) for n in range(50)], "q long, m long, a double, b double")
    f = fuse(df, "q", "m", SCORES)
    p = positions(f, "q", "m").orderBy("position").collect()
    assert [x.position for x in p] == list(range(1, 51))
    assert sorted((x.total, -x.m) for x in p) == [(x.total, -x.m) for x in reversed(p)]
    assert [x.m for x in top(f, "q", "m", 3).orderBy("position").collect()] == [x.m for x in p[:3]]
    assert fuse(df.limit(0), "q", "m", SCORES).count() == 0


def test_no_score_prevails_by_its_range(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 10.0), (1, 2, 0.1, 1e9), (1, 3, 0.5, 20.0)], "q long, m long, a double, b double")
    big = fuse(df.withColumn("a", df.a * 1e12), "q", "m", SCORES).orderBy("m").collect()
    assert big == fuse(df, "q", "m", SCORES).orderBy("m").collect()
