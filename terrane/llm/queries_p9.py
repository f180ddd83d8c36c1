"""p9: documents that are template residue or error pages. No SQL: a fitted classifier decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.residue import residue
from terrane.runtime import table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents")).where("residue").select("doc_id").distinct()


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents without residue."""
    return table(spark, d, "documents").join(p9_found(spark, d), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


QUERIES = {"p9_found": p9_found, "p9_kept": p9_kept}
SQL: dict[str, str] = {}
