"""Chunk, vector and knowledge tables as relations: every change returns the new relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ranking import numbered

MAX_FILTER_KEYS = 32


def document_filter(filters: dict | None) -> list[int] | None:
    """The document ids of a filter; only document_id is supported."""
    if not filters:
        return None
    if len(filters) > MAX_FILTER_KEYS or set(filters) != {"document_id"}:
        raise ValueError("only document_id can be filtered on")
    ids = sorted(set(filters["document_id"]))
    if not all(isinstance(i, int) for i in ids):
        raise ValueError("document ids are integers")
    return ids


def add_chunks(store: DataFrame, new: DataFrame, order: list[str], id_col: str = "chunk_id") -> DataFrame:
    """`new` with ids that continue the greatest one, in `order`.
    """
    top = store.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    out = numbered(new, [F.col(c) for c in order], "_number")
    return out.join(F.broadcast(top)).withColumn(id_col, F.col("top") + F.col("_number")).drop("_number", "top")


def delete_by(store: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return store.join(keys.select(on).distinct(), on, "left_anti")


def update_by(store: DataFrame, new: DataFrame, on: str, columns: list[str], strict: bool = False) -> DataFrame:
    """Keyed overwrite of `columns`; a null in `new` keeps the old value. `strict`: an unknown key is an error."""
    if strict and not new.join(store.select(on), on, "left_anti").isEmpty():
        raise ValueError("some keys are not in the store")
    # a key that is updated twice fails the job that reads the result
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a key is updated twice")).cast("int"))
    n = new.groupBy(on).agg(*[F.first(c).alias(f"_new_{c}") for c in columns], once.alias("_once")).where("_once is null").drop("_once")
    out = store.join(n, on, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return out.select(*store.columns)


def accordance(chunks: DataFrame, vectors: DataFrame, chunk_id: str = "chunk_id", vector_id: str = "id") -> DataFrame:
    """(id, side): ids that only the chunks or only the vectors hold."""
    c, v = chunks.select(F.col(chunk_id).alias("id")).distinct(), vectors.select(F.col(vector_id).alias("id")).distinct()
    only = lambda a, b, name: a.join(b, "id", "left_anti").withColumn("side", F.lit(name))
    return only(c, v, "chunks").unionByName(only(v, c, "vectors"))


def add_member(knowledge: DataFrame, name: str, user: str, role: str) -> DataFrame:
    """The rows to append: nothing if the user has the base; a new base gets the greatest id + 1."""
    if role not in ("admin", "member"):
        raise ValueError("role is admin or member")
    ids = knowledge.agg(F.max(F.when(F.col("knowledge_name") == name, F.col("knowledge_id"))).alias("own"), F.max("knowledge_id").alias("top"), F.max("id").alias("last"), F.max(F.when((F.col("knowledge_name") == name) & (F.col("user_id") == user), 1)).alias("has"))
    return ids.where("has is null").select((F.coalesce("last", F.lit(0)) + 1).alias("id"), F.coalesce("own", F.coalesce("top", F.lit(0)) + 1).alias("knowledge_id"), F.lit(name).alias("knowledge_name"), F.lit(user).alias("user_id"), F.lit(role).alias("role"))


def removable_members(knowledge: DataFrame, force: bool = False) -> DataFrame:
    """Members that may be removed: not the last of a base, unless forced."""
    n = F.count("user_id").over(Window.partitionBy("knowledge_id"))
    return knowledge.withColumn("members", n).where((F.col("members") > 1) | F.lit(force))


def role_map(knowledge: DataFrame) -> DataFrame:
    """(knowledge_id, roles): users and roles of each base."""
    k = knowledge.where("user_id is not null").groupBy("knowledge_id", "user_id").agg(F.min("role").alias("role"))
    return k.groupBy("knowledge_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("user_id", "role")))).alias("roles"))


def apply_cipher(df: DataFrame, columns: list[str], cipher) -> DataFrame:
    """The columns through a callback (Column to Column) that encrypts what is stored or decrypts what is read; nulls stay."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), cipher(F.col(c))) for c in columns})
