"""References to records that do not exist.

Signed counts are kept per key and changed only by deltas: +1/-1 for a reference that appears or is retracted,
+1/-1 for a registration, +1/-1 for an entry of the removal log. A key with positive references and no existence is
an orphan. Deltas are summed before the shuffle (map-side combine), so a key that holds a third of all rows costs one
row per task.

Defined results: a null or zero key refers to nothing; a removal counts whatever its time; a repeated registration or
removal changes a count but not existence; a record without a time is never late; records delivered twice are one
record; empty tables give empty reports.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.runtime import materialize

STATE = ["key", "refs", "registered", "removed", "first_seen", "first_ref"]
#: A key with more than this share of all references is joined in SALTS parts; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE, SALTS = 0.005, 32


def references(table: DataFrame, name: str, row_id: str, ref: str, time: str = "create_time") -> DataFrame:
    """(src_table, row_id, key, at) of one referring table, whatever other columns it has."""
    return table.select(
        F.lit(name).alias("src_table"), F.col(row_id).alias("row_id"), F.col(ref).alias("key"), F.col(time).alias("at")
    ).where("key is not null and key <> 0")


def _delta(df: DataFrame, key: Column, refs: int, registered: int, removed: int, seen: Column, ref_at: Column) -> DataFrame:
    return df.select(
        key.cast("bigint").alias("key"),
        F.lit(refs).cast("bigint").alias("refs"),
        F.lit(registered).cast("bigint").alias("registered"),
        F.lit(removed).cast("bigint").alias("removed"),
        seen.cast("timestamp_ntz").alias("first_seen"),
        ref_at.cast("timestamp_ntz").alias("first_ref"),
    ).where("key is not null")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    return _delta(refs, F.col("key"), sign, 0, 0, F.lit(None), F.col("at"))


def registration_deltas(registry: DataFrame, key: str = "document_id", time: str = "create_time", sign: int = 1) -> DataFrame:
    return _delta(registry, F.col(key), 0, sign, 0, F.col(time), F.lit(None))


def removal_deltas(log: DataFrame, key: str = "document_id", sign: int = 1) -> DataFrame:
    return _delta(log, F.col(key), 0, 0, sign, F.lit(None), F.lit(None))


def apply_deltas(state: DataFrame | None, deltas: Iterable[DataFrame]) -> DataFrame:
    """New state from the old one and change deltas; both are rows of the same form, so a batch is one aggregation.

    first_seen and first_ref keep the least time ever seen; a retraction does not raise them, which only makes more
    keys candidates for the exact check of `dangling`.
    """
    parts = [d.select(*STATE) for d in deltas] + ([state.select(*STATE)] if state is not None else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sums = [F.sum(c).alias(c) for c in ("refs", "registered", "removed")]
    return out.groupBy("key").agg(*sums, F.min("first_seen").alias("first_seen"), F.min("first_ref").alias("first_ref"))


def with_existence(state: DataFrame) -> DataFrame:
    """existence: 1 if registered and not removed, else 0 or less."""
    return state.withColumn("existence", F.when(F.col("registered") > 0, 1).otherwise(0) - F.when(F.col("removed") > 0, 1).otherwise(0))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existence, with the reason."""
    return with_existence(state).where("refs > 0 and existence <= 0").select(
        "key", "refs", F.when(F.col("removed") > 0, "deleted").otherwise("missing").alias("reason")
    )


def dangling(refs: DataFrame, state: DataFrame) -> DataFrame:
    """(src_table, row_id, at, reason), one row per dangling record.

    `state` should be materialised: it is read for the keys in question and for the hot keys among them.
    """
    total = state.agg(F.sum("refs")).first()[0] or 0
    doubtful = with_existence(state).where("refs > 0").where("existence <= 0 or first_seen > first_ref").select(
        "key", "refs", "removed", "registered", "first_seen"
    )
    # at most 1 / HOT_SHARE keys can pass this filter, so the list is bounded
    hot = [r[0] for r in doubtful.where(F.col("refs") > max(total * HOT_SHARE, 10_000)).select("key").collect()]
    salted = F.col("key").isin(hot) if hot else F.lit(False)
    left = refs.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("src_table", "row_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = doubtful.withColumn("salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    reason = (
        F.when(F.col("removed") > 0, "deleted")
        .when(F.col("registered") <= 0, "missing")
        .when(F.col("first_seen") > F.col("at"), "late")
    )
    return left.join(right, ["key", "salt"]).withColumn("reason", reason).where("reason is not null").select("src_table", "row_id", "at", "reason").distinct()


def reference_report(tables: list[DataFrame], registry: DataFrame, log: DataFrame) -> DataFrame:
    """Dangling records of `tables` (results of `references`) against a registry and a removal log."""
    refs = tables[0]
    for t in tables[1:]:
        refs = refs.unionByName(t)
    state = materialize(apply_deltas(None, [reference_deltas(refs), registration_deltas(registry), removal_deltas(log)]), "refcounts")
    return dangling(refs, state)


def by_period(found: DataFrame) -> DataFrame:
    """Dangling records counted per table, month of the record and reason; a record without a time has a null month."""
    month = F.date_format(F.col("at"), "yyyy-MM").alias("month")
    return found.groupBy("src_table", month, "reason").agg(F.count(F.lit(1)).alias("n_records"))
