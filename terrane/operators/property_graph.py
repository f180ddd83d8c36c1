"""The surface of a property graph: nodes (id, attrs MAP<STRING,STRING>) and edges (src, dst, relation, attrs) as relations.

Changes return the new relation; lookups are joins with the asked keys, so many are answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators.ranking import first_seen
from terrane.runtime import discard, materialize

_MAP = "map<string,string>"


def empty_attributes() -> Column:
    return F.create_map().cast(_MAP)


def add_nodes(nodes: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Nodes that are not there yet, each as it comes first; a node that is there keeps its attributes."""
    n = first_seen(new.where("id is not null"), ["id"], order).select("id", F.coalesce("attrs", empty_attributes()).alias("attrs"))
    return nodes.select("id", "attrs").unionByName(n.join(nodes.select("id"), "id", "left_anti"))


def has(keys: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """The keys with a flag `there`; a null key is not there."""
    return keys.join(held.select(*on).distinct().withColumn("there", F.lit(True)), on, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def attributes(keys: DataFrame, held: DataFrame, on: list[str], key: str | None = None) -> DataFrame:
    """The attributes of the asked nodes or edges, or one of them; unknown ones have an empty map, or null."""
    found = keys.join(held.select(*on, "attrs"), on, "left")
    if key is not None:
        return found.withColumn("value", F.col("attrs").getItem(key)).drop("attrs")
    return found.withColumn("attrs", F.coalesce("attrs", empty_attributes()))


def _put(attrs: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(attrs, lambda k, v: k != key), F.create_map(key, value))


def set_attribute(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Sets one attribute of the nodes in values (id, value); unknown nodes are ignored."""
    v = values.groupBy("id").agg(F.max("value").alias("value"))
    return nodes.join(v, "id", "left").select("id", F.when(F.col("value").isNotNull(), _put(F.col("attrs"), F.lit(name), F.col("value"))).otherwise(F.col("attrs")).alias("attrs"))


def joined_set(values: Column) -> Column:
    """Comma-joined parts of several texts: trimmed, distinct, sorted, without empty ones."""
    parts = F.flatten(F.transform(values, lambda v: F.transform(F.split(v, ","), lambda x: F.trim(x))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ",")


def update_attributes(held: DataFrame, updates: DataFrame, on: list[str], append: bool = False) -> DataFrame:
    """Applies updates (on..., key, value), several of one key at once: with `append` the parts of the old value stay beside
    the new ones. Unknown nodes or edges are ignored."""
    u = updates.where("key is not null and value is not null").groupBy(*on, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    u = u.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("_new"))
    old = lambda k: F.array(F.coalesce(F.col("attrs")[k], F.lit(""))) if append else F.array().cast("array<string>")
    fresh = F.transform_values("_new", lambda k, v: joined_set(F.concat(old(k), v)))
    kept = F.map_filter("attrs", lambda k, v: ~F.map_contains_key(F.col("_new"), k))
    return held.join(u, on, "left").withColumn("attrs", F.when(F.col("_new").isNotNull(), F.map_concat(kept, fresh)).otherwise(F.col("attrs"))).drop("_new")


def nodes_where(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return nodes.where(F.col("attrs").getItem(key) == value).select("id")


def nodes_containing(nodes: DataFrame, key: str, part: str) -> DataFrame:
    return nodes.where(F.contains(F.col("attrs").getItem(key), F.lit(part))).select("id")


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def edge_values(edges: DataFrame, key: str) -> DataFrame:
    """(value) of every edge, null where an edge has no such attribute."""
    return edges.select(F.col("attrs").getItem(key).alias("value"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): one JSON object per node (id and attributes) and link (source, target, relation and attributes)."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.map_concat(F.create_map(F.lit("id"), F.col("id")), F.map_filter("attrs", lambda k, v: k != "id"))).alias("json"))
    named = F.create_map(F.lit("source"), F.col("src"), F.lit("target"), F.col("dst"), F.lit("relation"), F.col("relation"))
    e = edges.select(F.lit("link").alias("kind"), F.to_json(F.map_concat(named, F.map_filter("attrs", lambda k, v: ~k.isin("source", "target", "relation")))).alias("json"))
    return n.unionByName(e)


def from_node_link(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what `node_link` gave; lines that are no objects are left out."""
    m = lines.withColumn("m", F.from_json("json", _MAP))
    n = m.where("kind = 'node' and m['id'] is not null").select(F.col("m")["id"].alias("id"), F.map_filter("m", lambda k, v: k != "id").alias("attrs"))
    e = m.where("kind = 'link' and m['source'] is not null and m['target'] is not null")
    rest = F.map_filter("m", lambda k, v: ~k.isin("source", "target", "relation"))
    return n, e.select(F.col("m")["source"].alias("src"), F.col("m")["target"].alias("dst"), F.col("m")["relation"].alias("relation"), rest.alias("attrs"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, cipher=None) -> None:
    """Node-link JSON, a partition a file; `cipher` (Column to Column) encrypts each line."""
    lines = node_link(nodes, edges)
    (lines.withColumn("json", cipher(F.col("json"))) if cipher else lines).write.mode("overwrite").json(path)


def load_graph(spark: SparkSession, path: str, decipher=None) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.schema("kind string, json string").json(path)
    return from_node_link(lines.withColumn("json", decipher(F.col("json"))) if decipher else lines)


def strong_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component): nodes that reach each other, named by the least of them.

    Rounds of colouring: nodes without edges on one side left are components of their own; among the others every node takes
    the greatest id that reaches it, and what reaches a colour's own node backwards within the colour is its component. All
    steps are joins and partial aggregates; every round is written and the one before removed.
    """
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    left, done, last = materialize(e.where("src <> dst"), "edges"), None, None
    for _ in range(rounds):
        # ends that no cycle passes
        while True:
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            kept = materialize(inner, "edges")
            same = kept.count() == left.count()
            discard(left)
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = materialize(left.select(F.col("src").alias("id")).union(left.select(F.col("dst").alias("id"))).distinct().withColumn("colour", F.col("id")), "colour")
        while True:
            reach = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("other"))
            new = materialize(colour.join(reach, "id", "left").select("id", F.greatest("colour", "other").alias("colour")), "colour")
            changed = new.join(colour.withColumnRenamed("colour", "was"), "id").where("colour <> was").isEmpty()
            discard(colour)
            colour = new
            if changed:
                break
        c = lambda side: colour.select(F.col("id").alias(side), F.col("colour").alias(f"colour_{side}"))
        inside = materialize(left.join(c("src"), "src").join(c("dst"), "dst").where("colour_src = colour_dst").select("src", "dst"), "inside")
        member = colour.where("id = colour")
        front = member
        while True:
            front = materialize(inside.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "colour").distinct().join(member.select("id"), "id", "left_anti"), "front")
            if front.isEmpty():
                break
            member = materialize(member.unionByName(front), "member")
        last = member
        done = last if done is None else done.unionByName(last)
        gone = last.select("id")
        left = materialize(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    else:
        raise RuntimeError(f"strong components did not settle in {rounds} rounds")
    if done is None:
        return nodes.withColumn("component", F.col("id"))
    named = done.withColumn("component", F.min("id").over(Window.partitionBy("colour"))).select("id", "component")
    return nodes.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
