"""p6: one ranking per query from the scores in the metadata of retrieved documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.fusion import fuse, positions, top
from terrane.runtime import table

SCORES = {"dense_score": "desc", "sparse_score": "desc", "rerank_score": "desc", "view_count": "desc", "l2_distance": "asc"}


def _scored(spark: SparkSession, d: str) -> DataFrame:
    schema = "query_id string, " + ", ".join(f"{s} string" for s in SCORES)
    m = table(spark, d, "mx_document").select("mx_id", F.from_json("metadata", schema).alias("m"))
    return m.select("mx_id", F.expr("try_cast(m.query_id AS bigint)").alias("query_id"), *[F.expr(f"try_cast(m.{s} AS double)").alias(s) for s in SCORES]).where("query_id is not null")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse(_scored(spark, d), "query_id", "mx_id", SCORES)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top(_fused(spark, d), "query_id", "mx_id", 3).select("query_id", "mx_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return positions(_fused(spark, d), "query_id", "mx_id").withColumn("total", F.round("total", 9))


_VALUE = "coalesce(CASE WHEN isfinite(try_cast(m->>'{s}' AS DOUBLE)) THEN {sign}try_cast(m->>'{s}' AS DOUBLE) END, 'infinity'::DOUBLE) AS {s}"
_RANKED = (
    "WITH m AS (SELECT mx_id, metadata::JSON AS m FROM mx_document WHERE json_valid(metadata)), "
    "s AS (SELECT mx_id, try_cast(m->>'query_id' AS BIGINT) AS query_id, "
    + ", ".join(_VALUE.format(s=s, sign="-" if o == "desc" else "") for s, o in SCORES.items())
    + " FROM m WHERE try_cast(m->>'query_id' AS BIGINT) IS NOT NULL), "
    "r AS (SELECT query_id, mx_id, round("
    + " + ".join(f"1.0 / (60 + rank() OVER (PARTITION BY query_id ORDER BY {s}))" for s in SCORES)
    + ", 12) AS total FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, mx_id) AS position FROM r) "
)

QUERIES = {"p6_found": p6_found, "p6_ranking": p6_ranking}
SQL = {
    "p6_found": _RANKED + "SELECT query_id, mx_id FROM p WHERE position <= 3",
    "p6_ranking": _RANKED + "SELECT query_id, mx_id, round(total, 9) AS total, position FROM p",
}
