"""Operations of the chunk, vector and knowledge stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import ranking as R
from terrane.operators import stores as S
from terrane.runtime import table

_KEY = ["chunk_id", "document_id", "document_name"]


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks_table").select(*_KEY, F.md5("chunk_content").alias("content")).distinct()


def chunk_add_ids(s: SparkSession, d: str) -> DataFrame:
    """The retrieved documents appended to the chunk store."""
    new = table(s, d, "mx_document").select("mx_id", "document_name")
    return S.add_chunks(_chunks(s, d), new, ["mx_id"]).select("chunk_id", "mx_id")


def chunk_delete(s: SparkSession, d: str) -> DataFrame:
    return S.delete_by(_chunks(s, d).where("document_id is not null"), table(s, d, "deleted_documents"), "document_id").select("chunk_id", "document_id")


def chunk_update(s: SparkSession, d: str) -> DataFrame:
    new = _chunks(s, d).where("chunk_id % 7 = 0").select("chunk_id", F.upper("content").alias("content")).dropDuplicates(["chunk_id"])
    return S.update_by(_chunks(s, d), new, "chunk_id", ["content"]).select("chunk_id", "content")


def chunk_lookup(s: SparkSession, d: str) -> DataFrame:
    """Point lookups as one join: chunks of the hybrid rows."""
    return table(s, d, "hybrid_model").select(F.col("id").alias("chunk_id")).join(_chunks(s, d).select("chunk_id", "content"), "chunk_id")


def document_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks_table").select("document_id").where("document_id is not null").distinct()


def chunks_of_documents(s: SparkSession, d: str) -> DataFrame:
    ids = S.document_filter({"document_id": [17, 100, 101, 17]})
    return _chunks(s, d).where(F.col("document_id").isin(ids)).select("chunk_id", "document_id")


def store_accordance(s: SparkSession, d: str) -> DataFrame:
    """Chunk ids against the ids of both vector tables."""
    v = table(s, d, "dense_model").select("id").unionByName(table(s, d, "hybrid_model").select("id"))
    return S.accordance(table(s, d, "chunks_table"), v)


def vector_update(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "dense_model").select("id", "document_id", F.size("vector").alias("dims"))
    new = v.where("id % 5 = 0").select("id", F.lit(0).alias("dims"))
    return S.update_by(v, new, "id", ["dims"])


def vector_delete(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "dense_model").select("id", "document_id")
    return S.delete_by(v, v.where("document_id = 17"), "id").agg(F.count(F.lit(1)).alias("n"))


def registry_first(s: SparkSession, d: str) -> DataFrame:
    """A document registered again keeps its first registration."""
    return R.first_seen(table(s, d, "document_table"), ["document_id"], ["create_time", "document_name"]).select("document_id", "knowledge_id", "create_time")


def doc_registry_join(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_table").select("knowledge_id", "user_id")
    return table(s, d, "document_table").join(k, "knowledge_id").where("user_id is not null").groupBy("user_id").agg(F.countDistinct("document_id").alias("n_documents"))


def admin_check(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_table")
    return k.where("user_id is not null").groupBy("knowledge_name", "user_id").agg(F.max(F.col("role") == "admin").alias("is_admin"))


def last_member_guard(s: SparkSession, d: str) -> DataFrame:
    return S.removable_members(table(s, d, "knowledge_table")).select("id", "knowledge_id", "members")


def role_map(s: SparkSession, d: str) -> DataFrame:
    r = S.role_map(table(s, d, "knowledge_table"))
    return r.select("knowledge_id", F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("roles"))


def knowledge_add(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_table")
    return S.add_member(k, "Brand new base", "user_9999", "admin").unionByName(S.add_member(k, "Gopoli", "user_9999", "member"))


def delete_cascade(s: SparkSession, d: str) -> DataFrame:
    """Rows left per table when the removed documents go from registry, chunks and vectors."""
    gone, out = table(s, d, "deleted_documents"), None
    for t in ("document_table", "chunks_table", "dense_model", "hybrid_model"):
        n = S.delete_by(table(s, d, t).select("document_id"), gone, "document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_C = "c AS (SELECT DISTINCT chunk_id, document_id, document_name, md5(chunk_content) AS content FROM chunks_table)"

QUERIES = {
    "chunk_add_ids": chunk_add_ids,
    "chunk_delete": chunk_delete,
    "chunk_update": chunk_update,
    "chunk_lookup": chunk_lookup,
    "document_ids": document_ids,
    "chunks_of_documents": chunks_of_documents,
    "store_accordance": store_accordance,
    "vector_update": vector_update,
    "vector_delete": vector_delete,
    "registry_first": registry_first,
    "doc_registry_join": doc_registry_join,
    "admin_check": admin_check,
    "last_member_guard": last_member_guard,
    "role_map": role_map,
    "knowledge_add": knowledge_add,
    "delete_cascade": delete_cascade,
}
SQL = {
    "chunk_add_ids": "SELECT (SELECT max(chunk_id) FROM chunks_table) + row_number() OVER (ORDER BY mx_id) AS chunk_id, mx_id FROM mx_document",
    "chunk_delete": f"WITH {_C} SELECT chunk_id, document_id FROM c WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM deleted_documents)",
    "chunk_update": f"WITH {_C} SELECT chunk_id, CASE WHEN chunk_id % 7 = 0 THEN upper(content) ELSE content END AS content FROM c",
    "chunk_lookup": f"WITH {_C} SELECT chunk_id, content FROM hybrid_model h JOIN c ON c.chunk_id = h.id",
    "document_ids": "SELECT DISTINCT document_id FROM chunks_table WHERE document_id IS NOT NULL",
    "chunks_of_documents": f"WITH {_C} SELECT chunk_id, document_id FROM c WHERE document_id IN (17, 100, 101)",
    "store_accordance": "WITH v AS (SELECT id FROM dense_model UNION SELECT id FROM hybrid_model), c AS (SELECT DISTINCT chunk_id AS id FROM chunks_table) SELECT id, 'chunks' AS side FROM c WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT id, 'vectors' FROM v WHERE id NOT IN (SELECT id FROM c)",
    "vector_update": "SELECT id, document_id, CASE WHEN id % 5 = 0 THEN 0 ELSE coalesce(len(vector), CASE WHEN vector IS NULL THEN NULL END) END AS dims FROM dense_model",
    "vector_delete": "SELECT count(*) AS n FROM dense_model WHERE document_id IS DISTINCT FROM 17",
    "registry_first": "SELECT document_id, knowledge_id, create_time FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY create_time NULLS FIRST, document_name NULLS FIRST) AS n FROM document_table) WHERE n = 1",
    "doc_registry_join": "SELECT user_id, count(DISTINCT document_id) AS n_documents FROM document_table JOIN knowledge_table USING (knowledge_id) WHERE user_id IS NOT NULL GROUP BY 1",
    "admin_check": "SELECT knowledge_name, user_id, bool_or(role = 'admin') AS is_admin FROM knowledge_table WHERE user_id IS NOT NULL GROUP BY 1, 2",
    "last_member_guard": "SELECT id, knowledge_id, members FROM (SELECT *, count(user_id) OVER (PARTITION BY knowledge_id) AS members FROM knowledge_table) WHERE members > 1",
    "role_map": "SELECT knowledge_id, string_agg(user_id || '=' || role, ',' ORDER BY user_id) AS roles FROM (SELECT knowledge_id, user_id, min(role) AS role FROM knowledge_table WHERE user_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "knowledge_add": "SELECT max(id) + 1 AS id, max(knowledge_id) + 1 AS knowledge_id, 'Brand new base' AS knowledge_name, 'user_9999' AS user_id, 'admin' AS role FROM knowledge_table UNION ALL SELECT max(id) + 1, coalesce(max(CASE WHEN knowledge_name = 'Gopoli' THEN knowledge_id END), max(knowledge_id) + 1), 'Gopoli', 'user_9999', 'member' FROM knowledge_table",
    "delete_cascade": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t} WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM deleted_documents)" for t in ("document_table", "chunks_table", "dense_model", "hybrid_model")),
}
