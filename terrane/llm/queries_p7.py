"""p7: passages of evaluation items in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.leaks import RUN, leaks
from terrane.runtime import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), exact_only=True)
    return found.where(F.col("run") >= RUN).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its kind: an exact run, or a paraphrase by the common subsequence."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumn("kind", F.when(F.col("run") >= RUN, "exact").otherwise("paraphrase"))


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
SQL: dict[str, str] = {}
