"""p8: a training mix of the documents with the shares of mix_targets. No SQL: the sizes are tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.mixture import mix
from terrane.runtime import table


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
