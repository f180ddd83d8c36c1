"""p2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.operators import references as R
from terrane.runtime import materialize, table

REFERRING = (("chunks_table", "chunk_id"), ("dense_model", "id"), ("hybrid_model", "id"))


def _refs(spark: SparkSession, d: str) -> list[DataFrame]:
    return [R.references(table(spark, d, t), t, row_id, "document_id") for t, row_id in REFERRING]


def _report(spark: SparkSession, d: str) -> DataFrame:
    return R.reference_report(_refs(spark, d), table(spark, d, "document_table"), table(spark, d, "deleted_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("src_table", "row_id", "reason").distinct()


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    return R.by_period(_report(spark, d))


def p2_orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same state maintained in two batches: the registry first, then the references and removals."""
    refs = _refs(spark, d)
    first = materialize(R.apply_deltas(None, [R.registration_deltas(table(spark, d, "document_table"))]), "refcounts")
    state = R.apply_deltas(first, [*map(R.reference_deltas, refs), R.removal_deltas(table(spark, d, "deleted_documents"))])
    return R.orphan_keys(state)


def p2_after_retraction(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys after a batch that takes back every reference of hybrid_model, every second removal and every fifth
    registration from a stored state."""
    refs, reg, log = _refs(spark, d), table(spark, d, "document_table"), table(spark, d, "deleted_documents")
    state = materialize(R.apply_deltas(None, [*map(R.reference_deltas, refs), R.registration_deltas(reg), R.removal_deltas(log)]), "refcounts")
    back = [R.reference_deltas(refs[2], -1), R.removal_deltas(log.where("document_id % 2 = 0"), sign=-1), R.registration_deltas(reg.where("document_id % 5 = 0"), sign=-1)]
    return R.orphan_keys(R.apply_deltas(state, back))


_ROWS = """
WITH refs AS (
  SELECT 'chunks_table' AS src_table, chunk_id AS row_id, document_id AS k, create_time AS t FROM chunks_table
  UNION ALL SELECT 'dense_model', id, document_id, create_time FROM dense_model
  UNION ALL SELECT 'hybrid_model', id, document_id, create_time FROM hybrid_model),
reg AS (SELECT document_id AS k, min(create_time) AS seen FROM document_table WHERE document_id IS NOT NULL GROUP BY document_id),
del AS (SELECT DISTINCT document_id AS k FROM deleted_documents),
rows_ AS (
  SELECT DISTINCT src_table, row_id, t,
    CASE WHEN del.k IS NOT NULL THEN 'deleted' WHEN reg.k IS NULL THEN 'missing' WHEN reg.seen > t THEN 'late' END AS reason
  FROM refs LEFT JOIN reg ON refs.k = reg.k LEFT JOIN del ON refs.k = del.k
  WHERE refs.k IS NOT NULL AND refs.k <> 0)
"""

QUERIES = {"p2_found": p2_found, "p2_by_month": p2_by_month, "p2_orphan_keys": p2_orphan_keys, "p2_after_retraction": p2_after_retraction}
SQL = {
    "p2_after_retraction": "WITH r AS (SELECT document_id AS key FROM chunks_table UNION ALL SELECT document_id FROM dense_model), k AS (SELECT key, count(*) AS refs FROM r WHERE key IS NOT NULL AND key <> 0 GROUP BY 1), x AS (SELECT key, refs, key IN (SELECT document_id FROM deleted_documents WHERE document_id % 2 <> 0) AS gone, key IN (SELECT document_id FROM document_table WHERE document_id % 5 <> 0) AS known FROM k) SELECT key, refs, CASE WHEN gone THEN 'deleted' ELSE 'missing' END AS reason FROM x WHERE gone OR NOT known",
    "p2_found": _ROWS + "SELECT DISTINCT src_table, row_id, reason FROM rows_ WHERE reason IS NOT NULL",
    "p2_by_month": _ROWS + "SELECT src_table, strftime(t, '%Y-%m') AS month, reason, count(*) AS n_records FROM rows_ WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    "p2_orphan_keys": _ROWS.replace("rows_ AS (\n  SELECT DISTINCT", "rows_ AS (\n  SELECT refs.k AS rk,")
    + "SELECT rk AS key, count(*) AS refs, reason FROM rows_ WHERE reason IN ('deleted', 'missing') GROUP BY rk, reason",
}
