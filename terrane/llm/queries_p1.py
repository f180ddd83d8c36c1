"""p1: the ten most similar vectors, each table within itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.neighbours import neighbours
from terrane.runtime import table

TABLES = ("dense_model", "hybrid_model")


def _all(spark: SparkSession, d: str, divisor: int) -> DataFrame:
    parts = [neighbours(table(spark, d, t), asked=F.col("id") % divisor == 0).select(F.lit(t).alias("src_table"), "*") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, 50).select("src_table", "id", "neighbour_id")


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows, with rank and similarity."""
    return _all(spark, d, 100)


QUERIES = {"p1_found": p1_found, "p1_search": p1_search}
SQL: dict[str, str] = {}
