"""Relations from texts by a model: three prompts a text, answers parsed and repaired."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.repair import ENTITY, EVENT, parsed_groups, parsed_triples

KINDS = ("entity_relation", "event_entity", "event_relation")


def extract_relations(docs: DataFrame, generate: Callable[[Column], Column], prompts: dict[str, str], marker: str = "", mend: Callable[[Column], Column] | None = None) -> DataFrame:
    """(raw_text, file_id, entity_relations, event_entity_relations, event_relations, and the three answers) of docs
    (text, source). `mend` asks a model to repair an answer that nothing else reads. Texts that are null or blank ask
    nothing and have empty lists."""
    if set(prompts) != set(KINDS) or not all(isinstance(p, str) and p for p in prompts.values()):
        raise ValueError(f"prompts are texts for {', '.join(KINDS)}")
    asked = docs.select(F.col("text").alias("raw_text"), F.col("source").alias("file_id"))
    ok = F.trim(F.coalesce("raw_text", F.lit(""))) != ""
    said = asked.select("*", *[F.when(ok, generate(F.concat(F.lit(prompts[k]), F.col("raw_text")))).otherwise("").alias(f"answer_{k}") for k in KINDS])
    again = lambda k: mend(F.col(f"answer_{k}")) if mend else None
    return said.select(
        "raw_text",
        "file_id",
        parsed_triples(F.col("answer_entity_relation"), ENTITY, marker, again("entity_relation")).alias("entity_relations"),
        parsed_groups(F.col("answer_event_entity"), marker).alias("event_entity_relations"),
        parsed_triples(F.col("answer_event_relation"), EVENT, marker, again("event_relation")).alias("event_relations"),
        *[f"answer_{k}" for k in KINDS],
    )


def relation_counts(records: DataFrame) -> DataFrame:
    """(file_id, entities, participants, events): sizes for the judge of an extraction."""
    inner = F.aggregate("event_entity_relations", F.lit(0), lambda a, x: a + F.size(x["entities"]))
    return records.select("file_id", F.size("entity_relations").alias("entities"), inner.alias("participants"), F.size("event_relations").alias("events"))


def bracket_entities(text: Column) -> Column:
    """The entities of the first [...] of a text, parted by ', ' between single quotes."""
    inner = F.regexp_extract(text, r"\[([^\[\]]*)\]", 1)
    parts = F.transform(F.split(inner, "', '"), lambda x: F.regexp_replace(x, r"^'+|'+$", ""))
    return F.when(text.rlike(r"\[[^\[\]]*\]"), parts).otherwise(F.array().cast("array<string>"))


def without_empty_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""), "\n")
