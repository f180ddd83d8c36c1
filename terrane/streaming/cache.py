"""Streaming forms: access counts per window, and a cache whose entries are kept current batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Accesses per window and kind, late rows up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


def keep_entries(path: str):
    """A foreachBatch function that merges a batch's accesses into the entries stored below `path`, one version a batch, so a
    batch that is run again gives the same version."""

    def run(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(F.col("user_id").alias("key")).agg(F.min("ts").alias("inserted_at"), F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("hits"))
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{path}/v{number - 1}")
            new = old.unionByName(new).groupBy("key").agg(F.min("inserted_at").alias("inserted_at"), F.max("last_access").alias("last_access"), F.sum("hits").alias("hits"))
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return run
