import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import hooks, text as T
from terrane.functions.splitting import is_separator_line, markdown_split, protected_blocks, recursive_split, trim_to_tokens
from terrane.operators import caching as C
from terrane.operators import curation as U
from terrane.operators import graph as G
from terrane.operators import lexical as L
from terrane.operators import quality as Q
from terrane.operators import ranking as R
from terrane.operators import stores as S
from terrane.operators import vectors as V
from terrane.operators.components import connected_components


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


def test_components_equal_union_find(spark):
    r = random.Random(1)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7), (8, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_min_max_and_weights(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(1, 6)] + [(2.0, 2), (2.0, 2), (None, 3)], "s double, g int")
    rows = df.withColumn("n", R.min_max("s", ["g"])).orderBy("g", "s").collect()
    assert [x.n for x in rows] == [0, 0.25, 0.5, 0.75, 1, 0, 0, 0]
    w = [one(spark, R.dense_weight(F.col("q")), q="x" * n) for n in (1, 6, 10)]
    assert abs(w[0] - 0.4) < 0.05 and abs(w[1] - 0.55) < 1e-9 and abs(w[2] - 0.7) < 0.05


def test_hybrid_merges_by_content(spark):
    rows = [("dense_high", 0.95, "dense", 1), ("dense_low", 0.1, "dense", 2), ("both_part", 0.8, "dense", 3), ("sparse_high", 100.0, "sparse", 4), ("sparse_low", 10.0, "sparse", 5), ("both_part", 80.0, "sparse", 6)]
    df = spark.createDataFrame([(1, "a question", *x) for x in rows], "query_id int, query string, content string, score double, retrieval_type string, pos int")
    got = R.hybrid(df, 3).orderBy("rank").collect()
    assert [x.content for x in got] == ["both_part", "dense_high", "sparse_high"] and got[0].retrieval_type == "both"


def test_rrf_counts_ranks_from_zero(spark):
    lists = [(0, i, str(x)) for i, x in enumerate([1, 2, 3])] + [(1, i, str(x)) for i, x in enumerate([2, 3, 4])]
    got = R.rrf(spark.createDataFrame(lists, "list_no int, rank int, item string")).orderBy("position").collect()
    assert [x.item for x in got] == ["2", "3", "1", "4"] and got[2].score == round(1 / 60, 9)


def test_compression_keeps_the_crossing_sentence(spark):
    df = spark.createDataFrame([(1, 0, "aaaa", 0.1), (1, 1, "bbbb", 0.9), (1, 2, "cc", 0.5)], "k int, pos int, text string, score double")
    assert R.compress_by_score(df, ["k"], 0.5).first().text == "bbbbcc"


def test_text_functions(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="The Cat, a DOG!") == "cat dog"
    assert one(spark, T.sentences(F.col("t")), t="One. Two?  Three") == ["One.", "Two?", "Three"]
    assert one(spark, T.parse_score(F.col("t")), t="0.999") == 0.99 and one(spark, T.parse_score(F.col("t")), t="2") == 0.0
    assert one(spark, T.json_array_text(F.col("t")), t="x [1, [2]] y") == "[1, [2]]"
    assert one(spark, T.concept_list(F.col("t")), t="b, a,, b ") == ["b", "a"]
    assert [tuple(x) for x in one(spark, T.greedy_groups(F.array(*map(F.lit, [3, 4, 5, 2, 9])), 8), t="")] == [(0, 2), (2, 4), (4, 5)]
    assert one(spark, T.clean_subquery(F.col("t")), t="<think>a</think>\"Step 1: Who?\"") == "Who?"
    assert [one(spark, T.verdict(F.col("t")), t=x) for x in ("Yes.", "no, yes", "well YES no", "maybe")] == [True, False, True, False]
    assert one(spark, T.truncate_middle(F.col("t"), 3), t="abcdefghij") == "abchij"
    assert one(spark, T.excel_time(F.col("t")), t=0.5) == "12:00"


def test_metrics(spark):
    def prf(n, x, m):
        return tuple(one(spark, F.array(*Q.precision_recall_f1(F.lit(n), F.lit(x), F.lit(m))), t=1))

    assert prf(10, 2, 3) == (0.8, 0.7273, 0.7619) and prf(0, 0, 0) == (None,) * 3 and prf(5, 5, 2) == (None,) * 3
    gold = spark.createDataFrame([(1, "the cat sat here"), (1, "nothing at all"), (2, ""), (2, "x")], "item int, fact string")
    got = spark.createDataFrame([(1, "so the cat sat here today"), (1, ""), (2, "")], "item int, text string")
    assert {(x.item, x.hits, x.total) for x in Q.hits(gold, got).collect()} == {(1, 1, 2), (2, 0, 2)}
    p = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "item int, rank int, relevant int")
    assert {(x.item, x.precision) for x in Q.context_precision(p).collect()} == {(1, round((1 + 2 / 3) / 2, 6)), (2, 0.0)}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None)], "id long, vector array<float>")
    q = v.where("id = 1").select(F.col("id").alias("query_id"), "vector")
    assert [x.id for x in V.knn(q, v, 2, "ip").orderBy("rank").collect()] == [1, 3]
    assert [x.id for x in V.knn(q, v, 9, "l2", allow_self=False).orderBy("rank").collect()] == [3, 2]
    assert V.knn(q.limit(0), v, 2).count() == 0 and V.knn(q, v.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        V.knn(q, v, 0)
    assert one(spark, V.serialize_sparse(F.create_map(F.lit(2), F.lit(0.5), F.lit(1), F.lit(1.0)), 9), t=1) == "{1:1.0,2:0.5}/9"


def test_bm25_pairs_count_repeated_terms(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, "c d"), (3, "e f")], "doc_id long, text string")
    t = L.word_tokens(F.col("text"))
    q = spark.createDataFrame([(1, 1, "b"), (1, 1, "b"), (2, 2, "c"), (3, 3, "zz")], "query_id long, doc_id long, term string")
    got = {x.query_id: x.score for x in L.bm25_pairs(q, L.postings(d, t), L.corpus_stats(d, t)).collect()}
    assert got[1] > got[2] > 0 and got[3] == 0
    assert one(spark, L.word_tokens(F.col("t")), t="Ab-1 中文x") == ["ab", "1", "中", "文", "x"]


def test_stores(spark):
    c = spark.createDataFrame([(1, 10, "a"), (2, 11, "b")], "chunk_id long, document_id long, content string")
    new = spark.createDataFrame([("x", 2), ("y", 1)], "content string, pos int")
    assert [(x.chunk_id, x.content) for x in S.add_chunks(c, new, ["pos"]).orderBy("chunk_id").collect()] == [(3, "y"), (4, "x")]
    up = spark.createDataFrame([(1, "z")], "chunk_id long, content string")
    assert {x.content for x in S.update_by(c, up, "chunk_id", ["content"], True).collect()} == {"z", "b"}
    with pytest.raises(ValueError):
        S.update_by(c, up.withColumn("chunk_id", F.lit(9)), "chunk_id", ["content"], True)
    with pytest.raises(ValueError):
        S.document_filter({"other": [1]})


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "r1", "f2", 1), ("a", "b", "r2", "f1, f3", 2), ("b", "c", "r", "f", 3), ("d", "c", "r", "f", 4)], "src string, dst string, relation string, file_id string, seq int")
    first = G.add_edges(e, ["seq"])
    assert {x.relation for x in first.where("src = 'a'").collect()} == {"r1"}
    assert G.edge_files(e).where("src = 'a'").first().file_id == "f1,f2,f3"
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(x.id, x.depth) for x in G.k_hop(seeds, first, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(x.src, x.dst) for x in G.bfs_tree(seeds, first, 2).collect()} == {("a", "b"), ("b", "c")}


def test_cache(spark):
    l1 = spark.createDataFrame([("q", "one")], "query string, answer string")
    l2 = spark.createDataFrame([("q", "two"), ("p", "three")], "query string, answer string")
    got = {(x.query, x.answer, x.level) for x in C.lookup(spark.createDataFrame([("q",), ("p",), ("z",)], "query string"), [l1, l2]).collect()}
    assert got == {("q", "one", 0), ("p", "three", 1), ("z", None, None)}
    log = spark.createDataFrame([("s", k, i) for i, k in enumerate("abacab")], "shard string, k string, i int")
    r = C.replay(log, "shard", "k", ["i"], 2).first()
    assert (r.hits, r.misses, r.evictions) == (2, 4, 2)


def test_splitting_keeps_blocks_whole():
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    fence = "```python\n" + "x = 1\n" * 60 + "```"
    md = "# T\n" + "word " * 150 + "\n## A\n" + table + "\n" + fence + "\n### B\n" + "tail. " * 200
    kinds = [k for _, _, k in protected_blocks(md)]
    assert kinds == ["md_table", "fence"] and is_separator_line("|---|---|")
    parts = markdown_split(md, 500, 20)
    assert any(fence in p for p in parts) and any(table in p for p in parts)
    assert [k for _, _, k in protected_blocks("<table><tr><table></table></tr></table> ![i](u) [l](v) ```\nopen")] == ["html_table", "image", "link"]
    assert all(len(p) <= 40 for p in recursive_split("one two three. " * 30, 40))
    assert "".join(recursive_split("ab cd ef gh" * 9, 10)) == "ab cd ef gh" * 9
    assert trim_to_tokens("a b\nc d\ne", 4, lambda t: len(t.split())) == "a b\nc d"


def test_hooks_and_curation(spark):
    assert hooks.create("embedding", "none") is None and len(hooks.embed_double(["a b"])[0]) == 64
    calls = []
    flaky = hooks.retrying(lambda p: calls.append(1) or ["" if len(calls) < 3 else "ok"] * len(p))
    assert flaky(["x"]) == ["ok"] and len(calls) == 3
    q = spark.createDataFrame([(1, "Q1: who?\n\n问题2：what?\nwho?")], "doc_id long, t string")
    assert [x.query for x in U.qd_pairs(q, U.question_lines(F.col("t"))).orderBy("pos").collect()] == ["who?", "what?"]


def test_streaming_cache_matches_the_batch(spark, tmp_path):
    from terrane.streaming.cache import keep_entries

    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    q = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(keep_entries(str(tmp_path / "c"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "c" / "v2"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.entries(events, "user_id", "ts").collect()))
