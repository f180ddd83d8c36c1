"""p4: broken prompt and response pairs. No SQL: the labels come from a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.answers import defects, main_defect
from terrane.runtime import spread, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "correctness_classifier"), "pair_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_defect(p4_labels(spark, d))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return defects(_pairs(spark, d), table(spark, d, "documents"))


QUERIES = {"p4_found": p4_found, "p4_labels": p4_labels}
SQL: dict[str, str] = {}
