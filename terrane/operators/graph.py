"""Property graphs as two relations: nodes (id, ...) and edges (src, dst, relation, ...), one edge per (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ranking import first_seen
from terrane.runtime import materialize

MAX_DEPTH = 5


def merge_attribute(values: Column) -> Column:
    """Comma-joined sets united: trimmed, distinct, sorted, without empty ones. `values` is a grouped column."""
    parts = F.flatten(F.collect_set(F.transform(F.split(values, ","), lambda x: F.trim(x))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ",")


def add_edges(edges: DataFrame, order: list[str], last: bool = False) -> DataFrame:
    """One edge per (src, dst): the first relation wins, or the last for a bulk load that overwrites."""
    return first_seen(edges, ["src", "dst"], order, last)


def edge_files(edges: DataFrame) -> DataFrame:
    """(src, dst, file_id): the files of every mention are united, whichever relation won."""
    return edges.groupBy("src", "dst").agg(merge_attribute(F.col("file_id")).alias("file_id"))


def remove_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gone.select("id").distinct()
    left = edges.join(g.select(F.col("id").alias("src")), "src", "left_anti").join(g.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(g, "id", "left_anti"), left


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.select("id").join(i, "id", "left").join(o, "id", "left").fillna(0, ["in_degree", "out_degree"])


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: m / (n (n - 1)), 0 for at most one node."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))
    return n.join(F.broadcast(m)).select("n", "m", F.when(F.col("n") <= 1, 0.0).otherwise(F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def hop(seeds: DataFrame, edges: DataFrame, way: str = "out") -> DataFrame:
    """(id, neighbour) one hop from seeds (id): out, in or both."""
    e = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": both_ways(edges)}[way]
    return seeds.select(F.col("id").alias("src")).join(e, "src").select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).distinct()


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id").distinct()
    return edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")


def k_hop(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth): nodes within `depth` undirected hops of any seed, with the least depth; the frontier alone is joined."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is between 0 and {MAX_DEPTH}")
    e = both_ways(edges).distinct()
    reached = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    front = reached
    for k in range(1, depth + 1):
        step = front.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        front = materialize(step.withColumn("depth", F.lit(k)), "front")
        reached = reached.unionByName(front)
    return reached


def bfs_tree(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, src, dst, depth): per seed the edges that discover a node first; successors come before predecessors, then
    by the node the edge comes from."""
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst", F.lit(0).alias("way")).unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "dst", F.lit(1).alias("way")))
    named = "seed" in seeds.columns  # several nodes of one seed
    seen = front = (seeds.select("seed", "node") if named else seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"))).distinct()
    out = None
    for k in range(1, depth + 1):
        step = front.join(both, front.node == both["at"]).select("seed", "to", "at", "src", "dst", "way")
        new = step.join(seen.select("seed", F.col("node").alias("to")), ["seed", "to"], "left_anti")
        new = materialize(first_seen(new, ["seed", "to"], ["way", "at"]).withColumn("depth", F.lit(k)), "tree")
        front = new.select("seed", F.col("to").alias("node"))
        seen = seen.unionByName(front)
        rows = new.select("seed", "src", "dst", "depth")
        out = rows if out is None else out.unionByName(rows)
    return out


def contexts(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "src", "relation", "dst").alias("context"))


def event_triples(records: DataFrame) -> DataFrame:
    """(head, relation, tail): every entity of an event participates in it; blanks are dropped."""
    x = records.select(F.explode("event_entity_relations").alias("r")).select(F.trim("r.Event").alias("tail"), F.explode("r.Entity").alias("e"))
    return x.select(F.trim("e").alias("head"), F.lit("participate").alias("relation"), "tail").where("head <> '' and tail <> ''")


def merge_triples(records: DataFrame) -> DataFrame:
    """Edges of relation records (raw_text, file_id, seq, entity_relations, event_relations): head to tail, and both to the
    text they come from (text_conclude). Incomplete triples, self loops and records without a text are left out."""
    r = records.where("trim(raw_text) <> ''").select("raw_text", "file_id", "seq", F.explode(F.concat("entity_relations", "event_relations")).alias("t"))
    r = r.select("raw_text", "file_id", "seq", F.trim("t.Head").alias("h"), F.trim("t.Relation").alias("r"), F.trim("t.Tail").alias("t")).where("h <> '' and r <> '' and t <> '' and h <> t")
    e = lambda a, rel, b: F.struct(F.col(a).alias("src"), rel.alias("relation"), F.col(b).alias("dst"))
    conclude = F.lit("text_conclude")
    return r.select("file_id", "seq", F.explode(F.array(e("h", F.col("r"), "t"), e("h", conclude, "raw_text"), e("t", conclude, "raw_text"))).alias("e")).select("e.src", "e.relation", "e.dst", "file_id", "seq")


def concept_counts(rows: DataFrame) -> DataFrame:
    """(node_type, concept, n) from (node, concepts ARRAY, node_type)."""
    return rows.select("node_type", F.explode("concepts").alias("concept")).groupBy("node_type", "concept").agg(F.count(F.lit(1)).alias("n"))


def synsets(counts: DataFrame) -> DataFrame:
    """(cluster, concept, position, representative): by frequency, then name; the first stands for all."""
    w = Window.partitionBy("cluster").orderBy(F.col("n").desc(), "concept")
    return counts.withColumn("position", F.row_number().over(w)).withColumn("representative", F.first("concept").over(w))
