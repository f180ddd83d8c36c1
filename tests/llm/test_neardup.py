import random
from itertools import combinations

import numpy as np

from terrane.llm import neardup
from terrane.llm.fingerprints import ball_keys, min_symbols
from terrane.llm.neardup import TABLES, WIDTH, counted, group_pairs, near_duplicates, normal, similarity


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n))


def brute(docs, least):
    docs = {k: normal(t) for k, t in docs if k is not None and t is not None and len(normal(t)) >= 100}
    parent = {k: k for k in docs}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = {k: {t[i : i + 5] for i in range(len(t) - 4)} for k, t in docs.items()}
    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= least * max(len(x), len(y)):
            both = len(x & y)
            if both >= least * (len(x) + len(y) - both):
                parent[find(b)] = find(a)
    groups = {}
    for k in docs:
        groups.setdefault(find(k), []).append(k)
    return {p for g in groups.values() for p in combinations(sorted(g), 2)}


def edited(r, t, n):
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = words(r, 1)
    return " ".join(w)


def test_equals_brute_force(spark):
    r = random.Random(4)
    docs, k = [], 0
    for _ in range(60):
        base = words(r, r.choice([20, 60, 150]))
        for _ in range(r.choice([1, 1, 2, 4])):
            docs.append((k, edited(r, base, r.choice([0, 1, 2, 4]))))
            k += 1
    hot = words(r, 80)
    docs += [(1000 + i, hot.upper() if i % 2 else "  " + hot) for i in range(30)] + [(2000 + i, edited(r, hot, 3)) for i in range(40)]
    docs += [(5000, None), (5001, ""), (5002, "tiny"), (None, hot), (5003, words(r, 20_000)), docs[0], docs[0]]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in docs], "id long, text string, content string, uid int")
    groups, links = near_duplicates([(df, "id", "text")])
    got = {(x.a, x.b) for x in group_pairs(groups).collect()}
    want = brute(docs, 0.65)
    assert not got - want, sorted(got - want)[:5]
    assert len(want - got) <= 0.01 * len(want), (len(want), sorted(want - got)[:5])
    assert all(x.similarity >= 0.65 for x in links.collect())


def test_sources_are_apart_and_empty_tables_have_no_groups(spark):
    t = words(random.Random(1), 40)
    a = spark.createDataFrame([(1, t)], "id long, text string")
    groups, _ = near_duplicates([(a, "id", "text"), (a, "id", "text")])
    assert groups.count() == 0
    groups, links = near_duplicates([(a.limit(0), "id", "text")])
    assert groups.count() == 0 and links.count() == 0


def test_isolated_pairs_at_the_threshold_meet():
    # texts of distinct characters stand for sets of shingles
    r, keys = np.random.default_rng(3), lambda t: ball_keys(*min_symbols(t, 1, WIDTH * TABLES), TABLES, WIDTH)
    for m in (96, 250):
        shared, a, b = -(-2 * m * 65 // 165), [], []
        for _ in range(500):
            c = "".join(map(chr, r.choice(np.arange(0x10000, 0x20000), 2 * m - shared, replace=False)))
            a.append(c[:m])
            b.append(c[m - shared :])
        assert similarity(a[0], b[0], 1) >= 0.65
        met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(keys(a), keys(b))]
        assert np.mean(met) >= 0.99, (m, np.mean(met))


def test_every_link_of_a_group_is_counted(spark):
    r = random.Random(8)
    base = words(r, 150)
    docs = [(i, edited(r, base, 3)) for i in range(12)]
    docs += [(20, docs[5][1].upper()), (21, words(r, 60)), (22, words(r, 60))]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {x.uid: x.n_links for x in counted([(df, "id", "text")]).collect()}
    texts = {normal(t) for _, t in docs[:12]}
    want = {k: sum(u != normal(t) and similarity(normal(t), u) >= 0.65 for u in texts) for k, t in docs[:13]}
    assert got == want
    _, links = near_duplicates([(df, "id", "text")])
    assert links.count() * 2 == sum(want[k] for k in range(12))


def test_a_shared_template_gives_few_pairs_and_loses_no_links(spark):
    r = random.Random(11)
    shell = words(r, 150).split()

    def page(own):
        return " ".join(shell[:75] + own + shell[75:])

    docs, k = [], 0
    for i in range(450):
        own = words(r, 50).split()
        docs.append((k, page(own)))
        k += 1
        if i % 5 == 0:  # a partner that shares a part of what is its own
            mine = list(own)
            for j in r.sample(range(50), r.choice([12, 24, 36, 42])):
                mine[j] = words(r, 1)
            docs.append((k, page(mine)))
            k += 1
    df = spark.createDataFrame(docs, "id long, text string")
    seen = []
    keep, neardup.alike = neardup.alike, lambda pairs, s: (seen.append(pairs.count()), keep(pairs, s))[1]
    try:
        groups, _ = near_duplicates([(df, "id", "text")])
        got = {(x.a, x.b) for x in group_pairs(groups).collect()}
    finally:
        neardup.alike = keep
    assert sum(seen) <= 20 * len(docs), seen
    want = brute(docs, 0.65)
    assert not got - want and len(want - got) <= 0.03 * len(want), (len(want), len(want - got))


def test_hot_keys_are_joined_with_the_pivots_of_all_batches(spark):
    r = random.Random(5)
    base = words(r, 60)
    docs = [(i, edited(r, base, r.choice([0, 1, 2]))) for i in range(400)] + [(1000 + i, words(r, 60)) for i in range(50)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(4)
    groups, _ = near_duplicates([(df, "id", "text")])
    got = {(x.a, x.b) for x in group_pairs(groups).collect()}
    assert got == brute(docs, 0.65)
