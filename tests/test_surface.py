import io
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.functions import repair as J
from terrane.operators import caching as C
from terrane.operators import chains as H
from terrane.operators import evaluation as V
from terrane.operators import extraction as X
from terrane.operators import graph_retrieval as R
from terrane.operators import ingest as I
from terrane.operators import lexical as L
from terrane.operators import property_graph as P
from terrane.operators import sheets as S
from terrane.operators import vectors as K
from terrane.sources import office as O

W = 'xmlns:w="http://w"'
A = 'xmlns:a="http://a" xmlns:p="http://p"'
M = 'xmlns="http://m" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(path, files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_word_files(spark, tmp_path):
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:tbl><w:tr>{cell('name')}{cell('age')}</w:tr><w:tr>{cell('Ann')}{cell('7')}</w:tr></w:tbl><w:p/>"
    packed(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    packed(tmp_path / "empty.docx", {"word/document.xml": f"<w:document {W}><w:body></w:body></w:document>"})
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error is None) for r in O.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Hello there\n\nname: Ann，age: 7。\n\n", True), "broken.docx": (None, False)}
    assert O.table_text([["a", "b"]]) == "a；b。"


def test_slides(spark, tmp_path):
    text = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = f"<p:sp><p:txBody>{text('one')}{text('two')}</p:txBody></p:sp>"
    table = f"<p:graphicFrame><a:tbl><a:tr><a:tc>{text('h')}</a:tc></a:tr><a:tr><a:tc>{text('v')}</a:tc></a:tr></a:tbl></p:graphicFrame>"
    packed(tmp_path / "s.pptx", {f"ppt/slides/slide{n}.xml": f"<p:sld {A}><p:cSld><p:spTree>{shape if n != 2 else table}</p:spTree></p:cSld></p:sld>" for n in (1, 2, 10)})
    assert [(r.slide, r.text) for r in O.read_pptx(spark, str(tmp_path)).orderBy("slide").collect()] == [(1, "one two"), (2, "h: v。"), (3, "one two")]


def test_sheets(spark, tmp_path):
    rows = '<row><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>age</t></is></c></row><row><c r="B3" t="s"><v>1</v></c><c r="C3"><v>7</v></c></row><row><c r="C4"><v>0</v></c></row><row><c r="C5"><v>8</v></c></row>'
    book = f'<workbook {M}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    packed(tmp_path / "b.xlsx", {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/sharedStrings.xml": f"<sst {M}><si><t>name</t></si><si><r><t>An</t></r><r><t>n</t></r></si></sst>",
                                 "xl/worksheets/sheet1.xml": f'<worksheet {M}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="B3:B5"/></mergeCells></worksheet>', "xl/worksheets/sheet2.xml": f"<worksheet {M}><sheetData/></worksheet>"})
    got = {(r.sheet, r.row): r.text for r in O.read_xlsx(spark, str(tmp_path)).collect()}
    assert got == {("One", 3): "name:Ann;age:7;", ("One", 5): "name:Ann;age:8;"}
    cells = spark.createDataFrame([("s", 1, 1, "only")], "sheet string, row int, col int, value string")
    none = spark.createDataFrame([], "sheet string, top int, bottom int, left int, right int")
    assert S.sheet_lines(cells, none, ["sheet"]).count() == 0 and S.sheet_lines(cells.limit(0), none, ["sheet"]).count() == 0
    with pytest.raises(ValueError):
        bomb = io.BytesIO()
        packed(bomb, {"word/document.xml": "a" * 5_000_000})
        O.docx_text(bomb.getvalue())


def test_repair(spark):
    t = '"头实体": "a", "关系": \'b\', "尾实体":"c"} , "关系": "lost", "关系": "kept" "尾实体": \'d\', "头实体": "x"'
    assert [tuple(r) for r in one(spark, J.triples(F.col("t")), t=t)] == [("a", "b", "c"), (None, "kept", "d")]
    assert one(spark, J.triples(F.col("t")), t="") == []
    assert [tuple(r) for r in one(spark, J.parsed_triples(F.col("t")), t='say [{"头实体": "a b", "关系": "r", "尾实体": "c"}] end')] == [("ab", "r", "c")]
    assert one(spark, J.parsed_triples(F.col("t"), marker="Answer:"), t="nothing") == []
    assert [(r.event, r.entities) for r in one(spark, J.groups(F.col("t")), t='"事件": "e", "实体": ["a", \'b\', ""] "事件": "f"')] == [("e", ["a", "b"])]
    assert one(spark, X.bracket_entities(F.col("t")), t="x ['a', 'b c'] ['d']") == ["a", "b c"] and one(spark, X.bracket_entities(F.col("t")), t="none") == []
    with pytest.raises(ValueError):
        X.extract_relations(spark.createDataFrame([("a", "b")], "text string, source string"), lambda p: p, {"entity_relation": "x"})


def test_property_graph(spark):
    nodes = spark.createDataFrame([("a", {"t": "x, y"}), ("b", {})], "id string, attrs map<string,string>")
    more = P.add_nodes(nodes, spark.createDataFrame([("a", {"t": "no"}, 1), ("c", {"k": "2"}, 2), ("c", {"k": "1"}, 1), (None, {}, 1), ("d", None, 1)], "id string, attrs map<string,string>, seq int"), ["seq"])
    assert {r.id: r.attrs for r in more.collect()} == {"a": {"t": "x, y"}, "b": {}, "c": {"k": "1"}, "d": {}}
    u = spark.createDataFrame([("a", "t", "z,x"), ("a", "new", "q"), ("b", "t", " w ,"), ("zz", "t", "1"), ("a", None, "1")], "id string, key string, value string")
    assert {r.id: r.attrs for r in P.update_attributes(nodes, u, ["id"], True).collect()} == {"a": {"t": "x,y,z", "new": "q"}, "b": {"t": "w"}}
    assert {r.id: r.attrs.get("t") for r in P.update_attributes(nodes, u, ["id"]).collect()} == {"a": "x,z", "b": "w"}
    assert {r.id: r.there for r in P.has(spark.createDataFrame([("a",), ("q",), (None,)], "id string"), nodes, ["id"]).collect()} == {"a": True, "q": False, None: False}
    edges = spark.createDataFrame([("a", "b", "r", {"f": "1"}), ("b", "a", "s", None)], "src string, dst string, relation string, attrs map<string,string>")
    n, e = P.from_node_link(P.node_link(nodes, edges.fillna({}).withColumn("attrs", F.coalesce("attrs", P.empty_attributes()))))
    assert {r.id: r.attrs for r in n.collect()} == {r.id: r.attrs for r in nodes.collect()} and {(r.src, r.relation): r.attrs for r in e.collect()} == {("a", "r"): {"f": "1"}, ("b", "s"): {}}


def test_strong_components(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a"), ("e", "h"), ("a", "b"), (None, "a")]
    got = {r.id: r.component for r in P.strong_components(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g", "h": "h"}
    assert P.strong_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_contexts(spark):
    edges = spark.createDataFrame([("a", "b", "knows"), ("b", "t1", "text_conclude"), ("a", "t1", "text_conclude"), ("a", "t2", "text_conclude")], "src string, dst string, relation string")
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz")], "question_id int, id string")
    assert [(r.question_id, r.context) for r in R.question_contexts(nodes, edges, 2, 9).orderBy("pos").collect()] == [(1, "a text_conclude t1"), (1, "a text_conclude t2")]
    assert [r.context for r in R.question_contexts(nodes, edges, 1, 1, True).collect()] == ["t1"]
    got = R.graph_answers(spark.createDataFrame([(1, "q"), (2, "p")], "question_id int, question string"), R.question_contexts(nodes, edges, 1, 9), "{context} {question}", lambda p: F.upper(p))
    assert {r.question_id: r.result for r in got.collect()} == {1: "A TEXT_CONCLUDE T1\nA TEXT_CONCLUDE T2 Q", 2: " P"}


def test_upload(spark):
    reg = spark.createDataFrame([(7, 1, "old", "p"), (9, 2, "new", "p")], "document_id long, knowledge_id long, document_name string, path string")
    chunks = spark.createDataFrame([(40, 7, "old", "x"), (41, 9, "new", "y")], "chunk_id long, document_id long, document_name string, content string")
    vectors = spark.createDataFrame([(40, 7, [1.0]), (41, 9, [2.0])], "id long, document_id long, vector array<float>")
    files = [("new", "a", "aaa|bb"), ("old", "a", "zz"), ("none", "a", None), ("blank", "a", ""), ("bad", "a", "ok|nan"), ("two", "a", "first"), ("two", "b", "second"), (None, "a", "x")]
    f = spark.createDataFrame(files, "document_name string, path string, text string")
    split = lambda t: F.filter(F.split(t, r"\|"), lambda x: x != "")
    embed = lambda t: F.array(F.when(t == "nan", F.lit(float("nan"))).otherwise(F.length(t).cast("double")))
    r = I.upload(f, reg, chunks, vectors, 1, split, embed, 1)
    assert {(x.document_name, x.reason) for x in r["failed"].collect()} == {("old", "exists"), ("none", "unreadable"), ("blank", "empty"), ("bad", "embedding"), ("two", "exists")}
    assert [(x.document_id, x.knowledge_id, x.document_name) for x in r["registry"].where("document_id > 9").orderBy("document_id").collect()] == [(10, 1, "new"), (11, 1, "two")]
    assert [(x.chunk_id, x.document_id, x.content) for x in r["chunks"].where("chunk_id > 41").orderBy("chunk_id").collect()] == [(42, 10, "aaa"), (43, 10, "bb"), (44, 11, "first")]
    assert {x.id for x in r["vectors"].collect()} == {40, 41, 42, 43, 44}
    r = I.upload(f, reg, chunks, vectors, 1, split, embed, 1, force=True)
    assert {x.document_name for x in r["registry"].where("knowledge_id = 1").collect()} == {"new", "old", "two"} and {x.content for x in r["chunks"].collect()} == {"y", "aaa", "bb", "zz", "second"}
    none = I.upload(f.limit(0), reg, chunks, vectors, 1, split, embed, 1)
    assert none["failed"].count() == 0 and none["chunks"].count() == 2


def test_vector_stores(spark):
    store = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 6, [0.0, 1.0])], "id long, document_id long, vector array<float>")
    new = spark.createDataFrame([(3, 5, [1.0, 1.0])], store.schema)
    assert I.add_vectors(store, new, 2).count() == 3
    for rows in ([(1, 5, [1.0, 1.0])], [(4, 5, [1.0])], [(4, 5, None)], [(4, 5, [1.0, 1.0])] * 2, [(None, 5, [1.0, 1.0])]):
        with pytest.raises(ValueError):
            I.add_vectors(store, spark.createDataFrame(rows, store.schema), 2)
    with pytest.raises(ValueError):
        I.add_vectors(store, new, 2, dense=False, sparse=True)
    q = store.where("id = 1").select(F.col("id").alias("query_id"), "vector")
    assert [r.id for r in I.search_store(q, store, 1, documents=[6]).collect()] == [2]
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.5, 0.0, 1.0]), (4, [0.9, 0.1])], "id long, vector array<float>")
    assert [r.id for r in K.knn(q, mixed, 9).orderBy("rank").collect()] == [1, 4]


def test_a_filter_leaves_the_frequencies_alone(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a a d"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (1, "a"), (1, "zz")], "query_id long, term string")
    t = L.word_tokens(F.col("text"))
    whole = {r.doc_id: r.score for r in L.bm25_store(q, d, t, 5).collect()}
    part = {r.doc_id: r.score for r in L.bm25_store(q, d, t, 5, d.where("doc_id <> 3")).collect()}
    assert part == {k: v for k, v in whole.items() if k != 3} and set(whole) == {1, 2, 3}


def test_cache_chain(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "query string")
    cache = spark.createDataFrame([("a", '{"query":"A","result":"1"}'), ("b", "plain")], "query string, answer string")
    calls = []

    def chain(x):
        calls.append(x.count())
        return x.select("query", F.lit('{"result":"new"}').alias("answer"))

    got, left = H.cache_chain(q, cache, chain)
    assert {(r.query, r.hit, r.answer) for r in got.collect()} == {("a", True, '{"query":"a","result":"1"}'), ("b", True, "plain"), ("c", False, '{"result":"new"}')}
    assert calls == [1] and {r.query for r in left.collect()} == {"a", "b", "c"}
    e = spark.createDataFrame([(k, i) for i in range(20) for k in "abcdefgh"], "key string, at int")
    held = C.entries(e, "key", "at")
    kept = {r.key for r in C.keep(held, "rr", 3, 1).collect()}
    assert len(kept) == 3 and kept == {r.key for r in C.keep(held, "rr", 3, 1).collect()} and kept != {r.key for r in C.keep(held, "rr", 3, 5).collect()}


def test_evaluation(spark):
    items = spark.createDataFrame([(1, "The answer is Paris.", ["paris"], ["The cat sat.", "zz qq"]), (2, None, ["x"], [])], "item int, prediction string, answers array<string>, facts array<string>")
    got = spark.createDataFrame([(1, "so the cat sat here"), (1, None), (3, "x")], "item int, text string")
    assert {(r.item, r.is_correct, r.hits, r.total, r.recall) for r in V.evaluate_items(items, got).collect()} == {(1, True, 1, 2, 0.5), (2, False, 0, 0, 0.0)}
    assert one(spark, V.decoded(F.col("t")), t="a\\u00e9\"b") == "aé\"b" and one(spark, V.decoded(F.col("t")), t="\\uzz") == "\\uzz"
    r = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0)], "item int, rank int, relevant int")
    assert {(x.item, x.value) for x in V.reciprocal_rank(r).collect()} == {(1, 0.5), (2, 0.0)}
    assert {(x.item, x.value) for x in V.ranked_gain(r, 5).collect()} == {(1, 0.63093), (2, 0.0)}


def test_services(spark):
    from pyspark.errors import PySparkException

    from terrane.functions import services as V

    assert one(spark, V.sparse_vector(F.col("t")), t='[{"index":1,"value":1.0},{"index":1,"value":2.0}]') == {1: 2.0} and one(spark, V.sparse_vector(F.lit(None).cast("string"))) is None
    assert one(spark, V.rerank_scores(F.col("t"), F.lit(3)), t='[{"index":2,"score":0.5}]') == [0.0, 0.0, 0.5] and one(spark, V.rerank_scores(F.col("t"), F.lit(0)), t="[]") == []
    assert one(spark, V.dense_vectors(F.col("t")), t="[[1.0],[2.0]]") == [[1.0], [2.0]]
    for c in (V.sparse_vector(F.lit('[{"value":1.0}]')), V.rerank_scores(F.lit('[{"index":3,"score":1.0}]'), F.lit(3)), V.rerank_scores(F.lit('[{"index":1,"score":1.0},{"index":1,"score":1.0}]'), F.lit(3))):
        with pytest.raises(PySparkException):
            one(spark, c)


def test_metrics_by_name_and_empty_training_data(spark):
    from terrane.operators import training as N

    assert list(V.metrics_of(["faithfulness", "x", "faithfulness", "nv_accuracy"])) == ["faithfulness", "nv_accuracy"]
    with pytest.raises(ValueError):
        V.metrics_of(["x"])
    r = spark.createDataFrame([(1, 4.0), (1, None), (2, 7.0)], "item int, rating double")
    assert {(x.item, x.value) for x in V.METRICS["nv_accuracy"](r).collect()} == {(1, 1.0), (2, None)}
    d = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, content string")
    assert N.train_data(d, lambda t: t, [lambda q, t: F.length(q)], lambda q, t: F.lit("1"), lambda q, n: q).count() == 0


def test_a_key_updated_twice_fails_and_replay_is_per_shard(spark):
    from pyspark.errors import PySparkException

    from terrane.operators import stores as T

    store = spark.createDataFrame([(1, "a")], "id long, content string")
    with pytest.raises(PySparkException):
        T.update_by(store, spark.createDataFrame([(1, "x"), (1, "y")], store.schema), "id", ["content"]).collect()
    log = spark.createDataFrame([(s, k, i) for i, (s, k) in enumerate([("p", "a"), (None, "a"), ("p", "a"), (None, "b"), ("p", "b"), (None, "a"), ("p", "a")])], "shard string, k string, i int")
    assert {tuple(r) for r in C.replay(log, "shard", "k", ["i"], 1).collect()} == {("p", 1, 3, 2), (None, 0, 3, 2)}


def test_stores_in_a_folder(spark, tmp_path):
    from terrane.operators.storage import ChunkStore, VectorStore, create_storage

    c = ChunkStore(spark, str(tmp_path / "c"), lambda x: F.base64(F.encode(x, "UTF-8")), lambda x: F.decode(F.unbase64(x), "UTF-8"))
    assert c.all().count() == 0
    c.add(spark.createDataFrame([(5, "a", "one", 1), (6, "b", "two", 2)], "document_id long, document_name string, content string, n int"), ["n"])
    c.add(spark.createDataFrame([(6, "b", None, 1)], "document_id long, document_name string, content string, n int"), ["n"])
    c.update(spark.createDataFrame([(1, "ONE")], "chunk_id long, content string"))
    assert [(r.chunk_id, r.content) for r in c.all().orderBy("chunk_id").collect()] == [(1, "ONE"), (2, "two"), (3, None)]
    assert c.folder.read().where("content = 'ONE'").count() == 0
    assert c.delete(spark.createDataFrame([(6,), (9,)], "document_id long")) == 2 and ChunkStore(spark, str(tmp_path / "c")).all().count() == 1
    v = create_storage(spark, "index", str(tmp_path / "v"), dims=2, metric="cosine")
    v.add(spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 6, [0.0, 1.0]), (3, 5, [1.0, 1.0])], "id long, document_id long, vector array<float>"))
    q = spark.createDataFrame([(0, [2.0, 0.1])], "query_id long, vector array<float>")
    assert [r.id for r in v.search(q, 2).orderBy("rank").collect()] == [1, 3] and [r.id for r in v.as_retriever(3, 0.9)(q).collect()] == [1] and [r.id for r in v.search(q, 3, [6]).collect()] == [2]
    assert v.delete(spark.createDataFrame([(1,), (8,)], "id long")) == 1 and v.count() == 2
    v.update(spark.createDataFrame([(2, [5.0, 0.0])], "id long, vector array<float>"))
    assert [r.id for r in v.search(q, 1).collect()] == [2]
    v.clear()
    assert v.count() == 0 and v.search(q, 1).count() == 0
    v.drop()
    assert v.count() == 0
    for f in (lambda: VectorStore(spark, "x", kind="none"), lambda: create_storage(spark, "other", "x")):
        with pytest.raises(ValueError):
            f()


def test_concepts_and_graph_building(spark):
    from terrane.operators import concepts as N

    docs = spark.createDataFrame([("T1", "f1"), ("T2", "f2"), (None, "f3")], "text string, source string")
    said = {"E": '[{"头实体": "a", "关系": "knows", "尾实体": "b"}, {"头实体": "x", "关系": "is", "尾实体": "x"}]', "G": '[{"事件": "ev", "实体": ["a", ""]}]', "V": "[]"}
    answer = lambda p: F.when(p.startswith("E"), said["E"]).when(p.startswith("G"), said["G"]).otherwise(said["V"])
    nodes, edges, vectors = N.build_graph(docs, answer, {"entity_relation": "E", "event_entity": "G", "event_relation": "V"}, lambda c: F.array(F.length(c)))
    assert {r.id: r.attrs["type"] for r in nodes.collect()} == {"a": "entity", "b": "entity", "ev": "event", "T1": "passage", "T2": "passage"}
    got = {(r.src, r.dst): (r.relation, r.attrs["file_id"]) for r in edges.collect()}
    assert got[("a", "b")] == ("knows", "f1,f2") and got[("a", "ev")] == ("participate", "f1,f2") and got[("b", "T2")] == ("text_conclude", "f2") and len(got) == 8
    assert [(r.id, r.name) for r in vectors.orderBy("id").collect()] == [(0, "T1"), (1, "T2"), (2, "a"), (3, "b"), (4, "ev")]
    items = N.typed_items(nodes, edges)
    said_of = N.conceptualize(items, lambda p: F.concat(F.lit("c, "), p), {"entity": "{item}{context}", "relation": "r"}, N.neighbour_context(edges)).withColumn("at", F.lit(1))
    assert {r.item: r.concepts for r in said_of.collect()}["knows"] == ["c", "r"] and said_of.where("node_type = 'event'").count() == 0
    clusters = spark.createDataFrame([("c", 1), ("r", 1)], "concept string, cluster int")
    reps = N.representatives(said_of, clusters)
    assert {(r.concept, r.representative) for r in reps.collect()} == {("c", "c"), ("r", "c")}
    n2, e2 = N.attach(nodes, edges, N.concept_strings(said_of, reps, ["at"]))
    assert {r.attrs.get("synset") for r in n2.where("id in ('a', 'b')").collect()} == {"c"} and e2.where("relation = 'knows'").first().attrs["concepts"] == "c,r"
    assert one(spark, N.question_paragraphs(F.col("t")), t="x Q1: who?\n参考段落：p1 Q2：who?\n参考段落：p2 Q3: none Q4: a 参考段落 b 参考段落 c") == {"who?": "p2"}
    assert N.build_graph(docs.limit(0), answer, {"entity_relation": "E", "event_entity": "G", "event_relation": "V"}, lambda c: F.array(F.length(c)))[0].count() == 0
