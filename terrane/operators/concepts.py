"""Concepts of nodes and relations: prompts, synsets, attributes, databases of names, and building a graph from texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import concept_list, strip
from terrane.operators.extraction import extract_relations
from terrane.operators.graph import add_edges, edge_files, synsets
from terrane.operators.property_graph import add_nodes, empty_attributes, nodes_where, update_attributes
from terrane.operators.ranking import first_seen, numbered
from terrane.runtime import materialize


def typed_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, node_type): nodes whose attribute `type` is event or entity, and every relation once."""
    one = lambda k: nodes_where(nodes, "type", k).select(F.col("id").alias("item"), F.lit(k).alias("node_type"))
    return one("event").unionByName(one("entity")).unionByName(edges.where("relation is not null").select(F.col("relation").alias("item"), F.lit("relation").alias("node_type")).distinct())


def neighbour_context(edges: DataFrame) -> DataFrame:
    """(item, context): of every node one neighbour with its relation, the least of them, so runs agree."""
    near = edges.select(F.col("src").alias("item"), F.concat_ws(" ", "relation", "dst").alias("context")).unionByName(edges.select(F.col("dst").alias("item"), F.concat_ws(" ", "src", "relation").alias("context")))
    return near.groupBy("item").agg(F.min("context").alias("context"))


def conceptualize(items: DataFrame, generate: Callable[[Column], Column], prompts: dict[str, str], contexts: DataFrame | None = None) -> DataFrame:
    """(item, node_type, concepts): what a model answers about each item of a type with a prompt, of {item} and {context}."""
    x = items if contexts is None else items.join(contexts, "item", "left")
    context = F.coalesce("context", F.lit("")) if contexts is not None else F.lit("")
    prompt = None
    for kind, text in prompts.items():
        p = F.replace(F.replace(F.lit(text), F.lit("{item}"), F.col("item")), F.lit("{context}"), context)
        prompt = F.when(F.col("node_type") == kind, p) if prompt is None else prompt.when(F.col("node_type") == kind, p)
    return x.withColumn("_prompt", prompt).where("_prompt is not null").select("item", "node_type", concept_list(generate(F.col("_prompt"))).alias("concepts"))


def representatives(concepts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(concept, representative): the most frequent concept of the cluster (concept, cluster) each belongs to."""
    counts = concepts.select(F.explode("concepts").alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    return synsets(counts.join(clusters.select("concept", "cluster").distinct(), "concept")).select("concept", "representative")


def concept_strings(concepts: DataFrame, reps: DataFrame, order: list[str]) -> DataFrame:
    """(item, node_type, concepts, synset): the concepts of the last row of each item, joined by commas, and the distinct
    representatives of those that have one, sorted."""
    last = first_seen(concepts, ["item", "node_type"], order, last=True).select("item", "node_type", "concepts")
    known = last.select("item", "node_type", F.explode("concepts").alias("concept")).join(reps, "concept").groupBy("item", "node_type").agg(F.array_join(F.array_sort(F.collect_set("representative")), ",").alias("synset"))
    return last.join(known, ["item", "node_type"], "left").select("item", "node_type", F.array_join("concepts", ",").alias("concepts"), F.coalesce("synset", F.lit("")).alias("synset"))


def attach(nodes: DataFrame, edges: DataFrame, strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the attributes concepts and synset of their item; edges have those of their relation."""
    both = F.explode(F.map_from_arrays(F.array(F.lit("concepts"), F.lit("synset")), F.array("concepts", "synset"))).alias("key", "value")
    of_nodes = strings.where("node_type <> 'relation'").select(F.col("item").alias("id"), both)
    of_edges = edges.join(strings.where("node_type = 'relation'").select(F.col("item").alias("relation"), "concepts", "synset"), "relation").select("src", "dst", both)
    return update_attributes(nodes, of_nodes, ["id"]), update_attributes(edges, of_edges, ["src", "dst"])


def name_database(names: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, name, vector): the distinct names that are not blank, with ids from 0 in their order."""
    n = names.select(F.col("name").alias("name")).where(strip(F.col("name")) != "").distinct()
    return numbered(n, [F.col("name")], "_n").select((F.col("_n") - 1).alias("id"), "name", embed(F.col("name")).alias("vector"))


def build_graph(docs: DataFrame, generate: Callable[[Column], Column], prompts: dict[str, str], embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, vectors) of docs (text, source): relations extracted by a model, merged, and every node embedded.

    Heads and tails of entity relations are entities, those of event relations and the events of participants events, the
    texts they come from passages. Incomplete relations and self loops are left out.
    """
    r = materialize(extract_relations(docs, generate, prompts), "relations")
    triple = lambda c, kind: r.select("raw_text", "file_id", F.explode(c).alias("t"), F.lit(kind).alias("kind")).select("raw_text", "file_id", F.trim("t.head").alias("src"), F.trim("t.relation").alias("relation"), F.trim("t.tail").alias("dst"), F.col("kind").alias("a"), F.col("kind").alias("b"))
    part = r.select("raw_text", "file_id", F.explode("event_entity_relations").alias("g")).select("raw_text", "file_id", F.explode("g.entities").alias("e"), F.trim("g.event").alias("dst"))
    part = part.select("raw_text", "file_id", F.trim("e").alias("src"), F.lit("participate").alias("relation"), "dst", F.lit("entity").alias("a"), F.lit("event").alias("b"))
    t = triple("entity_relations", "entity").unionByName(triple("event_relations", "event")).unionByName(part).where("src <> '' and relation <> '' and dst <> '' and src <> dst")
    t = materialize(t, "triples")
    conclude = lambda end, kind: t.select(F.col(end).alias("src"), F.lit("text_conclude").alias("relation"), F.col("raw_text").alias("dst"), "file_id", F.col(kind).alias("a"), F.lit("passage").alias("b"))
    every = materialize(t.select("src", "relation", "dst", "file_id", "a", "b").unionByName(conclude("src", "a")).unionByName(conclude("dst", "b")), "mentions")
    edges = add_edges(every, ["relation", "file_id"]).select("src", "dst", "relation").join(edge_files(every), ["src", "dst"])
    ends = every.select(F.col("src").alias("id"), F.col("a").alias("type")).unionByName(every.select(F.col("dst").alias("id"), F.col("b").alias("type")))
    none = ends.limit(0).select("id", empty_attributes().alias("attrs"))
    nodes = add_nodes(none, ends.select("id", F.create_map(F.lit("type"), F.col("type")).alias("attrs"), "type"), ["type"])
    nodes = materialize(nodes, "nodes")
    return nodes, edges.select("src", "dst", "relation", F.create_map(F.lit("file_id"), F.col("file_id")).alias("attrs")), name_database(nodes.select(F.col("id").alias("name")), embed)


def question_paragraphs(text: Column, mark: str = "参考段落") -> Column:
    """Question to paragraph of every Q<n>: block that the mark parts in exactly two; of equal questions the last counts."""
    blocks = F.transform(F.split(text, r"Q\d+[:：]"), lambda b: F.split(b, mark + "[:：]?"))
    pairs = F.transform(F.filter(blocks, lambda p: F.size(p) == 2), lambda p: F.struct(strip(p[0]).alias("question"), strip(p[1]).alias("paragraph")))
    ok = F.filter(pairs, lambda p: p["question"] != "")
    last = F.filter(ok, lambda p, i: ~F.exists(F.slice(ok, i + 2, F.greatest(F.size(ok), F.lit(1))), lambda q: q["question"] == p["question"]))
    return F.map_from_entries(last)
