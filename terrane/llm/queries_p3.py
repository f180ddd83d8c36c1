"""p3: near-duplicate contents of chunks and of retrieved documents, each table within itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.neardup import counted, group_pairs, grouped
from terrane.runtime import materialize, table

SOURCES = (("chunks_table", "chunk_id", "chunk_content"), ("mx_document", "mx_id", "page_content"))


def _sources(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str]]:
    return [(table(spark, d, t), i, c) for t, i, c in SOURCES]


def _source(uid: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t, _, _ in SOURCES]), (F.pmod(F.col(uid), F.lit(len(SOURCES))) + 1).cast("int"))


def _id(uid: str) -> Column:
    return F.expr(f"({uid} - pmod({uid}, {len(SOURCES)})) div {len(SOURCES)}")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = group_pairs(materialize(grouped(_sources(spark, d)), "groups"))
    return pairs.select(_source("a").alias("src_table"), _id("a").alias("id_a"), _id("b").alias("id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with a partner: its group (the least id in it) and its number of links to other contents."""
    g = counted(_sources(spark, d))
    return g.select(_source("uid").alias("src_table"), _id("uid").alias("id"), _id("group_id").alias("group_id"), "n_links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
SQL: dict[str, str] = {}
