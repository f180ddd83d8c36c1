"""Graph operations on the graph of customers, suppliers, nations, regions and order priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import graph as G
from terrane.operators import vectors as V
from terrane.operators.components import connected_components
from terrane.runtime import materialize, table


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Every mention of an edge, with a sequence number and its file."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, a, r, b, seq, file: table(s, d, t).select(a.alias("src"), r.alias("relation"), b.alias("dst"), F.col(seq).cast("bigint").alias("seq"), file.alias("file_id"))
    out = edge("nation", name("n", "n_nationkey"), F.lit("part of"), name("r", "n_regionkey"), "n_nationkey", F.lit("f1"))
    out = out.unionByName(edge("supplier", name("s", "s_suppkey"), F.lit("works in"), name("n", "s_nationkey"), "s_suppkey", F.lit("f2")))
    out = out.unionByName(edge("customer", name("c", "c_custkey"), F.col("c_mktsegment"), name("n", "c_nationkey"), "c_custkey", F.lit("f3")))
    return out.unionByName(edge("orders", name("c", "o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), "o_orderkey", F.concat(F.lit("o"), (F.col("o_orderkey") % 3).cast("string"), F.lit(", f4"))))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return G.add_edges(_raw(s, d), ["seq"])


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


def _seeds(s: SparkSession, *ids: str) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "id string")


def edge_first_wins(s, d):
    return _edges(s, d).select("src", "dst", "relation")


def edge_last_wins(s, d):
    return G.add_edges(_raw(s, d), ["seq"], last=True).select("src", "dst", "relation")


def attr_union(s, d):
    return G.edge_files(_raw(s, d))


def degrees(s, d):
    e = _edges(s, d)
    return G.degrees(_nodes(e), e)


def density(s, d):
    e = _edges(s, d)
    return G.density(_nodes(e), e).withColumn("density", F.round("density", 9))


def successors(s, d):
    return G.hop(_seeds(s, "c1", "c2", "n3"), _edges(s, d), "out")


def predecessors(s, d):
    return G.hop(_seeds(s, "r1", "n3"), _edges(s, d), "in")


def neighbors_undirected(s, d):
    return G.hop(_seeds(s, "n3", "n4"), _edges(s, d), "both")


def remove_node(s, d):
    e = _edges(s, d)
    n, left = G.remove_node(_nodes(e), e, _seeds(s, "n3", "1-URGENT"))
    return n.agg(F.count(F.lit(1)).alias("n")).join(left.agg(F.count(F.lit(1)).alias("m")))


def induced_subgraph(s, d):
    e = _edges(s, d)
    return G.induced(_nodes(e).where("id rlike '^[nr]'"), e).select("src", "dst", "relation")


def khop_nodes(s, d):
    return G.k_hop(_seeds(s, "r1"), _edges(s, d), 2)


def khop_edges(s, d):
    e = _edges(s, d)
    return G.induced(G.k_hop(_seeds(s, "s1", "s2"), e, 2), e).select("src", "dst", "relation")


def bfs_tree(s, d):
    return G.bfs_tree(_seeds(s, "r1", "n3"), _edges(s, d), 2)


def wcc(s, d):
    return connected_components(_raw(s, d), "src", "dst")


def contexts(s, d):
    return G.contexts(_edges(s, d)).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


def triples_merge(s, d):
    """Relation records made of the evaluation items."""
    t = "array<struct<Head:string,Relation:string,Tail:string>>"
    i = table(s, d, "eval_items").select(
        F.col("passage").alias("raw_text"), F.col("lang").alias("file_id"), F.col("item_id").alias("seq"),
        F.array(F.struct(F.concat(F.lit(" "), "question").alias("Head"), F.col("task").alias("Relation"), F.col("answer").alias("Tail"))).cast(t).alias("entity_relations"),
        F.array(F.struct(F.col("answer").alias("Head"), F.lit("").alias("Relation"), F.col("lang").alias("Tail"))).cast(t).alias("event_relations"),
    )
    e = materialize(G.merge_triples(i), "triples")
    return G.add_edges(e, ["seq"]).select(F.md5("src").alias("src"), "relation", F.md5("dst").alias("dst")).join(G.edge_files(e).select(F.md5("src").alias("src"), F.md5("dst").alias("dst"), "file_id"), ["src", "dst"])


def event_participants(s, d):
    i = table(s, d, "eval_items").select(F.array(F.struct(F.col("lang").alias("Event"), F.split("task", "_").alias("Entity"))).alias("event_entity_relations"))
    return G.event_triples(i).groupBy("head", "relation", "tail").agg(F.count(F.lit(1)).alias("n"))


def concept_edges(s, d):
    """For every vector its 5 best others, above the threshold."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = V.knn(v.select(F.col("id").alias("query_id"), "vector"), v, 5, "ip", allow_self=False)
    return found.where("round(raw, 6) > 0.5").select("query_id", "id", F.round("raw", 6).alias("score"))


def concept_clusters(s, d):
    return connected_components(concept_edges(s, d), "query_id", "id")


def _concepts(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("node"), F.array_compact(F.array(F.lower(F.trim("source")), F.lower(F.trim("lang")))).alias("concepts"), F.when(F.col("doc_id") % 2 == 0, "entity").otherwise("event").alias("node_type"))
    return t


def concept_counts(s, d):
    return G.concept_counts(_concepts(s, d))


def synset_rep(s, d):
    c = G.concept_counts(_concepts(s, d)).groupBy("concept").agg(F.sum("n").alias("n")).withColumn("cluster", F.length("concept"))
    return G.synsets(c).select("cluster", "concept", "position", "representative")


def concept_topk(s, d):
    c = G.concept_counts(_concepts(s, d)).groupBy("concept").agg(F.sum("n").alias("n"))
    return c.orderBy(F.col("n").desc(), "concept").limit(5)


_RAW = "raw AS (SELECT 'n' || n_nationkey AS src, 'part of' AS relation, 'r' || n_regionkey AS dst, n_nationkey::BIGINT AS seq, 'f1' AS file_id FROM nation UNION ALL SELECT 's' || s_suppkey, 'works in', 'n' || s_nationkey, s_suppkey, 'f2' FROM supplier UNION ALL SELECT 'c' || c_custkey, c_mktsegment, 'n' || c_nationkey, c_custkey, 'f3' FROM customer{orders})"
_ORD = " UNION ALL SELECT 'c' || o_custkey, o_orderstatus, o_orderpriority, o_orderkey, 'o' || (o_orderkey % 3) || ', f4' FROM orders"
_E = "WITH RECURSIVE " + _RAW + ", e AS (SELECT src, dst, arg_min(relation, seq) AS relation FROM raw GROUP BY 1, 2), nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_FULL = _E.format(orders=_ORD)
_COMP = ", reach AS (SELECT src AS id, src AS o FROM b UNION SELECT r.id, b.dst FROM reach r JOIN b ON b.src = r.o) SELECT id, min(o) AS component FROM reach GROUP BY 1"
_CE = "x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS query_id, b.id, list_inner_product(a.v, b.v) AS s FROM x a JOIN x b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS k FROM p), ce AS (SELECT query_id, id, round(s, 6) AS score FROM r WHERE k <= 5 AND round(s, 6) > 0.5)"
_CC = "WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'entity' ELSE 'event' END AS node_type, unnest([lower(trim(source, ' ')), lower(trim(lang, ' '))]) AS concept FROM documents), k AS (SELECT node_type, concept, count(*) AS n FROM c WHERE concept IS NOT NULL GROUP BY 1, 2), a AS (SELECT concept, sum(n)::BIGINT AS n FROM k GROUP BY 1) "
_HOPS = ", h AS (SELECT {seed} AS id, 0 AS depth UNION SELECT b.dst, h.depth + 1 FROM h JOIN b ON b.src = h.id WHERE h.depth < 2), hn AS (SELECT id, min(depth) AS depth FROM h GROUP BY 1)"
_TREE = (
    ", dir AS (SELECT src AS a, dst AS t, src, dst, 0 AS way FROM e UNION ALL SELECT dst, src, src, dst, 1 FROM e), seeds AS (SELECT unnest(['r1', 'n3']) AS seed), "
    "d1 AS (SELECT * FROM (SELECT seed, t, src, dst, row_number() OVER (PARTITION BY seed, t ORDER BY way, a) AS k FROM seeds JOIN dir ON a = seed WHERE t <> seed) WHERE k = 1), "
    "d2 AS (SELECT * FROM (SELECT d1.seed, dir.t, dir.src, dir.dst, row_number() OVER (PARTITION BY d1.seed, dir.t ORDER BY way, a) AS k FROM d1 JOIN dir ON a = d1.t WHERE dir.t <> d1.seed AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.seed = d1.seed AND x.t = dir.t)) WHERE k = 1) "
    "SELECT seed, src, dst, 1 AS depth FROM d1 UNION ALL SELECT seed, src, dst, 2 FROM d2"
)

QUERIES = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "edge_first_wins": _FULL + " SELECT * FROM e",
    "edge_last_wins": _FULL + " SELECT src, dst, arg_max(relation, seq) AS relation FROM raw GROUP BY 1, 2",
    "attr_union": _FULL + ", f AS (SELECT DISTINCT src, dst, trim(unnest(string_split(file_id, ','))) AS x FROM raw) SELECT src, dst, string_agg(x, ',' ORDER BY x) AS file_id FROM f GROUP BY 1, 2",
    "degrees": _FULL + " SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM nodes",
    "density": _FULL + " SELECT n, m, round(m / (n * (n - 1))::DOUBLE, 9) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM e)",
    "successors": _FULL + " SELECT src AS id, dst AS neighbour FROM e WHERE src IN ('c1', 'c2', 'n3')",
    "predecessors": _FULL + " SELECT dst AS id, src AS neighbour FROM e WHERE dst IN ('r1', 'n3')",
    "neighbors_undirected": _FULL + " SELECT src AS id, dst AS neighbour FROM b WHERE src IN ('n3', 'n4')",
    "remove_node": _FULL + " SELECT (SELECT count(*) FROM nodes WHERE id NOT IN ('n3', '1-URGENT')) AS n, (SELECT count(*) FROM e WHERE src NOT IN ('n3', '1-URGENT') AND dst NOT IN ('n3', '1-URGENT')) AS m",
    "induced_subgraph": _FULL + " SELECT src, dst, relation FROM e WHERE regexp_matches(src, '^[nr]') AND regexp_matches(dst, '^[nr]')",
    "khop_nodes": _FULL + _HOPS.format(seed="'r1'") + " SELECT id, depth FROM hn",
    "khop_edges": _FULL + _HOPS.format(seed="unnest(['s1', 's2'])") + " SELECT src, dst, relation FROM e WHERE src IN (SELECT id FROM hn) AND dst IN (SELECT id FROM hn)",
    "bfs_tree": _FULL + _TREE,
    "wcc": _FULL + _COMP,
    "contexts": _FULL + " SELECT src || ' ' || relation || ' ' || dst AS context, count(*) AS n FROM e GROUP BY 1",
    "triples_merge": "WITH r AS (SELECT passage, lang, item_id, trim(question) AS h, trim(task) AS rel, trim(answer) AS t FROM eval_items WHERE trim(passage) <> ''), ok AS (SELECT * FROM r WHERE h <> '' AND rel <> '' AND t <> '' AND h <> t), e AS (SELECT h AS src, rel AS relation, t AS dst, lang AS f, item_id AS seq FROM ok UNION ALL SELECT h, 'text_conclude', passage, lang, item_id FROM ok UNION ALL SELECT t, 'text_conclude', passage, lang, item_id FROM ok) SELECT md5(src) AS src, md5(dst) AS dst, arg_min(relation, seq) AS relation, string_agg(DISTINCT f, ',' ORDER BY f) AS file_id FROM e GROUP BY e.src, e.dst",
    "event_participants": "WITH x AS (SELECT trim(unnest(string_split(task, '_'))) AS head, trim(lang) AS tail FROM eval_items) SELECT head, 'participate' AS relation, tail, count(*) AS n FROM x WHERE head <> '' AND tail <> '' GROUP BY 1, 3",
    "concept_edges": "WITH " + _CE + " SELECT * FROM ce",
    "concept_clusters": "WITH RECURSIVE " + _CE + ", b AS (SELECT query_id AS src, id AS dst FROM ce UNION SELECT id, query_id FROM ce)" + _COMP,
    "concept_counts": _CC + "SELECT * FROM k",
    "synset_rep": _CC + "SELECT length(concept)::INT AS cluster, concept, row_number() OVER w AS position, first_value(concept) OVER w AS representative FROM a WINDOW w AS (PARTITION BY length(concept) ORDER BY n DESC, concept)",
    "concept_topk": _CC + "SELECT concept, n FROM a ORDER BY n DESC, concept LIMIT 5",
}
QUERIES = {k: QUERIES[k] for k in SQL}
