"""Attributes, lookups, strong components and retrieval on the graph of the test tables, and relations read from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import hooks as H
from terrane.functions import repair as J
from terrane.operators import concepts as N
from terrane.operators import extraction as X
from terrane.operators import graph_retrieval as R
from terrane.operators import property_graph as P
from terrane.plans.graph_ops import _E, _ORD, _edges
from terrane.plans.vector_search import _V
from terrane.runtime import table


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _attrs(**columns):
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)])


def _places(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "region").select(_id("r", "r_regionkey").alias("id"), _attrs(name=F.col("r_name"), tags=F.lit("region, base")).alias("attrs"))
    n = table(s, d, "nation").select(_id("n", "n_nationkey").alias("id"), _attrs(name=F.col("n_name"), tags=F.lit("x, base"), part=_id("r", "n_regionkey")).alias("attrs"))
    return r.unionByName(n)


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select(_id("s", "s_suppkey").alias("id"), _attrs(name=F.col("s_name"), part=_id("n", "s_nationkey")).alias("attrs"), F.col("s_suppkey").cast("bigint").alias("seq"))


def _links(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"), F.lit("part of").alias("relation"), _attrs(file=F.lit("f2, f1")).alias("attrs"))
    p = table(s, d, "supplier").select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"), F.lit("works in").alias("relation"), _attrs(file=F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string"))).alias("attrs"))
    return n.unionByName(p)


def node_add(s, d):
    """Nations come again with other attributes and keep theirs; suppliers are new."""
    again = table(s, d, "nation").select(_id("n", "n_nationkey").alias("id"), _attrs(name=F.lit("again")).alias("attrs"), F.lit(0).cast("bigint").alias("seq"))
    return P.add_nodes(_places(s, d), again.unionByName(_suppliers(s, d)), ["seq"]).select("id", F.col("attrs")["name"].alias("name"))


def node_has(s, d):
    keys = table(s, d, "customer").select(F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("id")).distinct()
    return P.has(keys, _places(s, d), ["id"])


def edge_has(s, d):
    keys = table(s, d, "nation").select(_id("n", "n_nationkey").alias("src"), F.concat(F.lit("r"), (F.col("n_nationkey") % 5).cast("string")).alias("dst"))
    return P.has(keys, _links(s, d), ["src", "dst"])


def node_attribute(s, d):
    keys = table(s, d, "customer").select(F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("id")).distinct()
    return P.attributes(keys, _places(s, d), ["id"], "name")


def node_attributes(s, d):
    keys = table(s, d, "customer").select(F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("id")).distinct()
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return P.attributes(keys, _places(s, d), ["id"]).select("id", flat.alias("attrs"))


def edge_attribute(s, d):
    return P.attributes(_links(s, d).select("src", "dst"), _links(s, d), ["src", "dst"], "file")


def node_set_attribute(s, d):
    values = table(s, d, "supplier").select(_id("n", "s_nationkey").alias("id"), F.col("s_name").alias("value"))
    return P.set_attribute(_places(s, d), values, "contact").select("id", F.col("attrs")["contact"].alias("contact"), F.size("attrs").alias("n"))


def node_update_append(s, d):
    u = table(s, d, "supplier").select(_id("n", "s_nationkey").alias("id"), F.lit("tags").alias("key"), F.concat(F.lit("t"), (F.col("s_suppkey") % 3).cast("string"), F.lit(" , x,")).alias("value"))
    return P.update_attributes(_places(s, d), u, ["id"], append=True).select("id", F.col("attrs")["tags"].alias("tags"))


def edge_update(s, d):
    u = table(s, d, "supplier").select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"), F.lit("file").alias("key"), F.lit("z, a,z").alias("value"))
    return P.update_attributes(_links(s, d), u, ["src", "dst"]).select("src", "dst", F.col("attrs")["file"].alias("file"))


def nodes_by_attribute(s, d):
    return P.nodes_where(_places(s, d), "part", "r1")


def nodes_containing(s, d):
    return P.nodes_containing(_places(s, d), "name", "A")


def edge_remove(s, d):
    gone = table(s, d, "nation").where("n_nationkey % 2 = 0").select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"))
    return P.remove_edges(_links(s, d), gone).select("src", "dst")


def edge_attribute_values(s, d):
    return P.edge_values(_links(s, d), "file").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def node_link_round_trip(s, d):
    n, e = P.from_node_link(P.node_link(_places(s, d), _links(s, d)))
    rows = n.select("id", F.lit("").alias("dst"), F.col("attrs")["name"].alias("text")).unionByName(e.select(F.col("src").alias("id"), "dst", F.concat_ws("|", "relation", F.col("attrs")["file"]).alias("text")))
    return rows


def strong_components(s, d):
    """A region leads back to the first of its nations, and every nation to its first customer's nation."""
    back = table(s, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")).select(_id("r", "n_regionkey").alias("src"), _id("n", "k").alias("dst"))
    round_ = table(s, d, "nation").where("n_nationkey % 3 = 0").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst"))
    return P.strong_components(_links(s, d).select("src", "dst").unionByName(back).unionByName(round_))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(s, d):
    return _vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def text_node_search(s, d):
    v = _vectors(s, d)
    return R.search_text_nodes(_asked(s, d), v, v.where("label % 2 = 0"), 10)


def node_retrieve(s, d):
    v = _vectors(s, d)
    ends = v.groupBy("label").agg(F.min("id").alias("id"), F.max_by("vector", "id").alias("vector"))
    return R.retrieve_nodes(_asked(s, d), v, 5, ends.select("id", "vector"))


def _nodes_of_questions(s, d):
    """Two nodes a question: a nation and its first supplier."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("question_id"), _id("n", "n_nationkey").alias("id"))
    p = table(s, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).select(F.col("s_nationkey").alias("question_id"), _id("s", "k").alias("id"))
    return n.unionByName(p)


def question_contexts(s, d):
    return R.question_contexts(_nodes_of_questions(s, d), _edges(s, d), 1, 20)


def graph_answer(s, d):
    q = table(s, d, "nation").select(F.col("n_nationkey").alias("question_id"), F.col("n_comment" if "n_comment" in table(s, d, "nation").columns else "n_name").alias("question"))
    c = R.question_contexts(_nodes_of_questions(s, d), _edges(s, d), 1, 20)
    return R.graph_answers(q, c, "Context:\n{context}\nQuestion: {question}", H.generator()).select("question_id", F.size("contexts").alias("n"), "result")


def node_gather(s, d):
    """Entities of a question are two labels; the nodes found for a label are its first three."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("query_id"))
    from pyspark.sql import Window

    found = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where("rank <= 3")
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("question_id"), F.posexplode(F.array(F.col("label"), (F.col("label") + 1) % 10, F.col("label"))).alias("pos", "entity")).withColumn("entity", F.col("entity").cast("bigint"))
    return R.gather(e, found)


def _plain(c: str):
    return F.translate(F.col(c), "\"'[]", "")


def _broken(s, d, keys):
    """Mixed quotes and spaces; the second record lacks its relation, the third its tail."""
    k = [F.lit(f'"{x}":') for x in keys]
    text = F.concat(F.lit("[{"), k[0], F.lit(' "'), _plain("question"), F.lit('", '), k[1], F.lit("'"), _plain("task"), F.lit("',"), k[2], F.lit('   "'), _plain("answer"), F.lit('"} {'), k[0], F.lit('"h2" '), k[2], F.lit("'t2'"), F.lit(" ; "), k[0], F.lit('"h3", '), k[1], F.lit('"r3"'))
    return table(s, d, "eval_items").select("item_id", text.alias("t"))


def _repaired(keys):
    def run(s, d):
        return _broken(s, d, keys).select("item_id", F.posexplode(J.triples(F.col("t"), keys)).alias("pos", "r")).select("item_id", "pos", "r.head", "r.relation", "r.tail")

    return run


def repair_event_entity(s, d):
    t = F.concat(F.lit('{"事件": "'), _plain("question"), F.lit('", "实体": ["'), _plain("task"), F.lit("\", '"), _plain("lang"), F.lit("', \"\"]}, {\"事件\": 'e2', \"实体\": []}, {\"事件\": \"lost\""))
    x = table(s, d, "eval_items").select("item_id", F.posexplode(J.groups(t)).alias("pos", "g"))
    return x.select("item_id", "pos", F.col("g.event").alias("event"), F.array_join("g.entities", "|").alias("entities"))


def _tagged(s, d):
    one, two, three = _plain("question"), _plain("task"), _plain("answer")
    ent = F.concat(F.lit('<E>[{"头实体":"'), two, F.lit('","关系":"is","尾实体":"x"}]</E>'))
    eve = F.concat(F.lit("<G>[{'事件': '"), two, F.lit("', '实体': ['a', 'b']}]</G>"))
    bad = F.concat(F.lit('<V>"头事件": "'), one, F.lit('" "关系": "before" "尾事件": "'), three, F.lit('"</V>'))
    return table(s, d, "eval_items").select(F.concat(F.lit("\n"), ent, eve, bad).alias("text"), F.col("item_id").cast("string").alias("source"))


_ASK = {"entity_relation": "E", "event_entity": "G", "event_relation": "V"}


def _answer(p):
    """What stands between the tags of the asked kind: valid JSON, single quotes, and no JSON at all."""
    return F.regexp_extract(p, r"(?s)^(.).*<\1>(.*)</\1>", 2)


def graph_build(s, d):
    _, edges, _ = N.build_graph(_tagged(s, d), _answer, _ASK, lambda c: F.array(F.length(c)))
    return edges.select(F.md5("src").alias("src"), F.md5("dst").alias("dst"), "relation", F.md5(F.col("attrs")["file_id"]).alias("files"))


def name_database(s, d):
    x = N.name_database(table(s, d, "part").select(F.col("p_name").alias("name")), lambda c: F.array(F.length(c)))
    return x.select("id", "name", F.get("vector", F.lit(0)).alias("first"))


def generate_qa(s, d):
    """Questions and paragraphs of the documents' Q<n>: blocks."""
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.array_sort(F.map_entries(N.question_paragraphs(F.col("text")))).alias("x")).where("size(x) > 0")
    return t.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join(F.transform("x", lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")).alias("digest"))


def concept_attributes(s, d):
    """Concepts of nations from a model's list, clustered by their first letter."""
    nodes = _places(s, d)
    items = table(s, d, "nation").select(_id("n", "n_nationkey").alias("item"), F.lit("entity").alias("node_type"), F.array(F.lower("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("concepts"), F.lit(1).alias("at"))
    clusters = items.select(F.explode("concepts").alias("concept")).distinct().withColumn("cluster", F.left("concept", F.lit(1)))
    n, _ = N.attach(nodes, _links(s, d), N.concept_strings(items, N.representatives(items, clusters), ["at"]))
    return n.select("id", F.col("attrs")["concepts"].alias("concepts"), F.col("attrs")["synset"].alias("synset"))


def relation_extract(s, d):
    r = X.extract_relations(_tagged(s, d), _answer, _ASK)
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["head"], x["relation"], x["tail"])), ";")
    groups = F.array_join(F.transform("event_entity_relations", lambda x: F.concat(x["event"], F.lit("="), F.array_join(x["entities"], ","))), ";")
    return r.select("file_id", flat("entity_relations").alias("entity"), groups.alias("event_entity"), flat("event_relations").alias("event"))


def relation_counts(s, d):
    t = table(s, d, "eval_items").select(F.col("item_id").alias("file_id"), F.array(F.struct(F.lit("h").alias("head"), F.lit("r").alias("relation"), F.lit("t").alias("tail"))).alias("entity_relations"), F.array(F.struct(F.lit("e").alias("event"), F.split("task", "_").alias("entities")), F.struct(F.lit("f").alias("event"), F.array(F.lit("x")).alias("entities"))).alias("event_entity_relations"), F.array().cast(J.TRIPLE).alias("event_relations"))
    return X.relation_counts(t)


def bracket_entities(s, d):
    t = F.concat(F.lit("found: ['"), _plain("task"), F.lit("', '"), _plain("lang"), F.lit("'] and [more]"))
    return table(s, d, "eval_items").select("item_id", F.array_join(X.bracket_entities(F.when(F.col("item_id") % 4 == 0, "none").otherwise(t)), "|").alias("entities"))


def without_empty_lines(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(X.without_empty_lines(F.col("text"))).alias("digest"))


_PL = "pl AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'region, base' AS tags, NULL AS part FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'x, base', 'r' || n_regionkey FROM nation)"
_KEYS = "keys AS (SELECT DISTINCT 'n' || (c_custkey % 40) AS id FROM customer)"
_LN = "ln AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'part of' AS relation, 'f2, f1' AS file FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'works in', 'f' || (s_suppkey % 3) FROM supplier)"
_KNN = "x AS (" + _V + "), kn AS (SELECT q.id AS query_id, x.id, x.label, row_number() OVER (PARTITION BY q.id ORDER BY -round(list_inner_product(q.v, x.v), 9), x.id) AS rank FROM x q JOIN x ON true WHERE q.id % 100 = 0)"
_CLEAN = "regexp_replace({}, '[\"''\\[\\]]', '', 'g')"
_REP = f"WITH i AS (SELECT item_id, {_CLEAN.format('question')} AS q, {_CLEAN.format('task')} AS t, {_CLEAN.format('answer')} AS a FROM eval_items) SELECT item_id, 0 AS pos, q AS head, t AS relation, a AS tail FROM i UNION ALL SELECT item_id, 1, 'h2', NULL, 't2' FROM i"
_QC = (
    _E.format(orders=_ORD)
    + ", seeds AS (SELECT n_nationkey AS seed, 'n' || n_nationkey AS node FROM nation UNION ALL SELECT s_nationkey, 's' || min(s_suppkey) FROM supplier GROUP BY 1), dir AS (SELECT src AS a, dst AS t, src, dst, 0 AS way FROM e UNION ALL SELECT dst, src, src, dst, 1 FROM e), "
    "st AS (SELECT seed, t, src, dst, row_number() OVER (PARTITION BY seed, t ORDER BY way, a) AS k FROM seeds JOIN dir ON a = node WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.seed = seeds.seed AND z.node = dir.t)), "
    "qc AS (SELECT seed AS question_id, row_number() OVER (PARTITION BY seed ORDER BY src, dst) AS pos, src || ' ' || relation || ' ' || dst AS context FROM st JOIN e USING (src, dst) WHERE k = 1) "
)

QUERIES = {
    "node_add": node_add, "node_has": node_has, "edge_has": edge_has, "node_attribute": node_attribute, "node_attributes": node_attributes, "edge_attribute": edge_attribute, "node_set_attribute": node_set_attribute,
    "node_update_append": node_update_append, "edge_update": edge_update, "nodes_by_attribute": nodes_by_attribute, "nodes_containing": nodes_containing, "edge_remove": edge_remove, "edge_attribute_values": edge_attribute_values,
    "node_link_round_trip": node_link_round_trip, "strong_components": strong_components, "text_node_search": text_node_search, "node_retrieve": node_retrieve, "question_contexts": question_contexts, "graph_answer": graph_answer, "node_gather": node_gather,
    "repair_entity": _repaired(J.ENTITY), "repair_event": _repaired(J.EVENT), "repair_event_entity": repair_event_entity, "relation_extract": relation_extract, "relation_counts": relation_counts, "bracket_entities": bracket_entities, "without_empty_lines": without_empty_lines,
    "graph_build": graph_build, "name_database": name_database, "generate_qa": generate_qa, "concept_attributes": concept_attributes,
}
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEXT = " || ".join(("chr(10)", _quoted('<E>[{"头实体":"'), "t", _quoted('","关系":"is","尾实体":"x"}]</E>'), _quoted("<G>[{'事件': '"), "t", _quoted("', '实体': ['a', 'b']}]</G>"), _quoted('<V>"头事件": "'), "q", _quoted('" "关系": "before" "尾事件": "'), "a", _quoted('"</V>')))
SQL = {
    "graph_build": f"WITH i AS (SELECT item_id::VARCHAR AS f, {_CLEAN.format('question')} AS q, {_CLEAN.format('task')} AS t, {_CLEAN.format('answer')} AS a FROM eval_items), x AS (SELECT f, trim(q, ' ') AS q, trim(t, ' ') AS t, trim(a, ' ') AS a, {_TEXT} AS text FROM i), m AS (SELECT t AS src, 'is' AS relation, 'x' AS dst, text, f FROM x UNION ALL SELECT 'a', 'participate', t, text, f FROM x UNION ALL SELECT 'b', 'participate', t, text, f FROM x UNION ALL SELECT q, 'before', a, text, f FROM x), ok AS (SELECT * FROM m WHERE src <> '' AND dst <> '' AND src <> dst), e AS (SELECT src, relation, dst, f FROM ok UNION ALL SELECT src, 'text_conclude', text, f FROM ok UNION ALL SELECT dst, 'text_conclude', text, f FROM ok) SELECT md5(src) AS src, md5(dst) AS dst, min(relation) AS relation, md5(string_agg(DISTINCT f, ',' ORDER BY f)) AS files FROM e GROUP BY e.src, e.dst",
    "name_database": "SELECT row_number() OVER (ORDER BY name) - 1 AS id, name, length(name)::INT AS first FROM (SELECT DISTINCT p_name AS name FROM part WHERE trim(p_name) <> '')",
    "generate_qa": r"WITH b AS (SELECT doc_id, unnest(string_split_regex(text, 'Q\d+[:：]')) AS b, generate_subscripts(string_split_regex(text, 'Q\d+[:：]'), 1) AS i FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, i, string_split_regex(b, '参考段落[:：]?') AS p FROM b), k AS (SELECT doc_id, i, regexp_replace(p[1], '^\s+|\s+$', '', 'g') AS q, regexp_replace(p[2], '^\s+|\s+$', '', 'g') AS t FROM p WHERE len(p) = 2), l AS (SELECT doc_id, q, arg_max(t, i) AS t FROM k WHERE q <> '' GROUP BY 1, 2) SELECT doc_id, count(*)::INT AS n, md5(string_agg(q || '=' || t, '|' ORDER BY q)) AS digest FROM l GROUP BY 1",
    "concept_attributes": f"WITH {_PL}, c AS (SELECT 'n' || n_nationkey AS id, lower(n_name) AS a, 'r' || n_regionkey AS b FROM nation), k AS (SELECT concept, count(*) AS n FROM (SELECT a AS concept FROM c UNION ALL SELECT b FROM c) GROUP BY 1), r AS (SELECT concept, first_value(concept) OVER (PARTITION BY left(concept, 1) ORDER BY n DESC, concept) AS rep FROM k) SELECT pl.id, c.a || ',' || c.b AS concepts, CASE WHEN c.id IS NOT NULL THEN CASE WHEN ra.rep = rb.rep THEN ra.rep ELSE least(ra.rep, rb.rep) || ',' || greatest(ra.rep, rb.rep) END END AS synset FROM pl LEFT JOIN c USING (id) LEFT JOIN r ra ON ra.concept = c.a LEFT JOIN r rb ON rb.concept = c.b",
    "node_add": f"WITH {_PL} SELECT id, name FROM pl UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier",
    "node_has": f"WITH {_PL}, {_KEYS} SELECT id, id IN (SELECT id FROM pl) AS there FROM keys",
    "edge_has": "SELECT 'n' || n_nationkey AS src, 'r' || (n_nationkey % 5) AS dst, n_nationkey % 5 = n_regionkey AS there FROM nation",
    "node_attribute": f"WITH {_PL}, {_KEYS} SELECT id, name AS value FROM keys LEFT JOIN pl USING (id)",
    "node_attributes": f"WITH {_PL}, {_KEYS} SELECT id, CASE WHEN name IS NULL THEN '' ELSE concat_ws(';', 'name=' || name, 'part=' || part, 'tags=' || tags) END AS attrs FROM keys LEFT JOIN pl USING (id)",
    "edge_attribute": f"WITH {_LN} SELECT src, dst, file AS value FROM ln",
    "node_set_attribute": f"WITH {_PL}, c AS (SELECT 'n' || s_nationkey AS id, max(s_name) AS contact FROM supplier GROUP BY 1) SELECT id, contact, (CASE WHEN part IS NULL THEN 2 ELSE 3 END + (contact IS NOT NULL)::INT)::INT AS n FROM pl LEFT JOIN c USING (id)",
    "node_update_append": f"WITH {_PL}, u AS (SELECT DISTINCT 'n' || s_nationkey AS id, 't' || (s_suppkey % 3) AS t FROM supplier), a AS (SELECT id, t FROM u UNION SELECT id, 'x' FROM u UNION SELECT id, 'base' FROM u), g AS (SELECT id, string_agg(t, ',' ORDER BY t) AS tags FROM a GROUP BY 1) SELECT pl.id, coalesce(g.tags, pl.tags) AS tags FROM pl LEFT JOIN g ON g.id = pl.id",
    "edge_update": f"WITH {_LN} SELECT src, dst, CASE WHEN relation = 'works in' THEN 'a,z' ELSE file END AS file FROM ln",
    "nodes_by_attribute": "SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 1",
    "nodes_containing": f"WITH {_PL} SELECT id FROM pl WHERE contains(name, 'A')",
    "edge_remove": f"WITH {_LN} SELECT src, dst FROM ln WHERE NOT (relation = 'part of' AND substr(src, 2)::INT % 2 = 0)",
    "edge_attribute_values": f"WITH {_LN} SELECT file AS value, count(*) AS n FROM ln GROUP BY 1",
    "node_link_round_trip": f"WITH {_PL}, {_LN} SELECT id, '' AS dst, name AS text FROM pl UNION ALL SELECT src, dst, relation || '|' || file FROM ln",
    "strong_components": f"WITH RECURSIVE {_LN}, g AS (SELECT src, dst FROM ln UNION SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0), r AS (SELECT src AS a, dst AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b), n AS (SELECT src AS id FROM g UNION SELECT dst FROM g) SELECT id, least(id, coalesce(min(x.b), id)) AS component FROM n LEFT JOIN (SELECT f.a, f.b FROM r f JOIN r w ON f.a = w.b AND f.b = w.a) x ON x.a = n.id GROUP BY id",
    "text_node_search": f"WITH {_KNN} SELECT query_id, id, rank FROM kn WHERE rank <= 10 AND label % 2 = 0",
    "node_retrieve": f"WITH {_KNN}, c AS (SELECT label, min(id) AS id, arg_max(v, id) AS v FROM x GROUP BY 1), kc AS (SELECT q.id AS query_id, c.id, row_number() OVER (PARTITION BY q.id ORDER BY -round(list_inner_product(q.v, c.v), 9), c.id) AS rank FROM x q JOIN c ON true WHERE q.id % 100 = 0), f AS (SELECT query_id, id, rank AS seen FROM kn WHERE rank <= 5 UNION ALL SELECT query_id, id, rank + 5 FROM kc WHERE rank <= 5), o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(seen)) AS rank FROM f GROUP BY 1, 2) SELECT * FROM o WHERE rank <= 5",
    "question_contexts": _QC + "SELECT * FROM qc WHERE pos <= 20",
    "graph_answer": _QC + "SELECT n_nationkey AS question_id, (SELECT count(*) FROM qc WHERE question_id = n_nationkey AND pos <= 20)::INT AS n, n_name AS result FROM nation",
    "node_gather": "WITH f AS (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), e AS (SELECT vec_id AS question_id, label, 0 AS pos FROM embeddings UNION ALL SELECT vec_id, (label + 1) % 10, 1 FROM embeddings) SELECT question_id, f.id, row_number() OVER (PARTITION BY question_id ORDER BY pos, rank) AS pos FROM e JOIN f USING (label) WHERE rank <= 3",
    "repair_entity": _REP,
    "repair_event": _REP,
    "repair_event_entity": f"WITH i AS (SELECT item_id, {_CLEAN.format('question')} AS q, {_CLEAN.format('task')} AS t, {_CLEAN.format('lang')} AS l FROM eval_items) SELECT item_id, 0 AS pos, q AS event, t || '|' || l AS entities FROM i UNION ALL SELECT item_id, 1, 'e2', '' FROM i",
    "relation_extract": f"WITH i AS (SELECT item_id, {_CLEAN.format('question')} AS q, {_CLEAN.format('task')} AS t, {_CLEAN.format('answer')} AS a FROM eval_items) SELECT item_id::VARCHAR AS file_id, regexp_replace(t, '\\s', '', 'g') || '|is|x' AS entity, regexp_replace(t, '\\s', '', 'g') || '=a,b' AS event_entity, q || '|before|' || a AS event FROM i",
    "relation_counts": "SELECT item_id AS file_id, 1 AS entities, (len(string_split(task, '_')) + 1)::INT AS participants, 0 AS events FROM eval_items",
    "bracket_entities": f"SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE {_CLEAN.format('task')} || '|' || {_CLEAN.format('lang')} END AS entities FROM eval_items",
    "without_empty_lines": "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> ''), chr(10))) AS digest FROM documents WHERE text IS NOT NULL",
}
