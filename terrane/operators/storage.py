"""Stores in a folder: chunks and vectors as Parquet versions, changed as a whole and read as relations."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import stores as S
from terrane.operators.ingest import add_vectors, search_store
from terrane.operators.vectors import scale_score

KINDS = {"dense": ("vector",), "sparse": ("sparse_vector",), "hybrid": ("vector", "sparse_vector")}


class Folder:
    """A table in versions: a change writes the next one and then names it current, so readers and lost jobs see whole ones."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))]
        return sorted(n for n in names if n.startswith("v") and self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        last = self._versions()[-1:]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{last[0]}") if last else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, keep: int = 2) -> None:
        old = self._versions()
        df.write.parquet(f"{self.path}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        for n in old[: max(0, len(old) + 1 - keep)]:
            self._fs.delete(self._hadoop(f"{self.path}/{n}"), True)

    def drop(self) -> None:
        self._fs.delete(self._hadoop(self.path), True)


class ChunkStore:
    """Chunks (chunk_id, document_id, document_name, content); contents go through the callbacks where any are given."""

    SCHEMA = "chunk_id bigint, document_id bigint, document_name string, content string"

    def __init__(self, spark: SparkSession, path: str, encrypt: Callable[[Column], Column] | None = None, decrypt: Callable[[Column], Column] | None = None):
        self.folder, self.encrypt, self.decrypt = Folder(spark, path, self.SCHEMA), encrypt or (lambda c: c), decrypt or (lambda c: c)

    def all(self) -> DataFrame:
        return S.apply_cipher(self.folder.read(), ["content"], self.decrypt)

    def add(self, new: DataFrame, order: list[str]) -> None:
        """new is (document_id, document_name, content); ids continue the greatest one."""
        held = self.folder.read()
        more = S.apply_cipher(S.add_chunks(held, new, order), ["content"], self.encrypt)
        self.folder.write(held.unionByName(more.select(*held.columns)))

    def update(self, new: DataFrame) -> None:
        """new is (chunk_id, content); unknown ids are an error."""
        self.folder.write(S.update_by(self.folder.read(), S.apply_cipher(new, ["content"], self.encrypt), "chunk_id", ["content"], strict=True))

    def delete(self, documents: DataFrame) -> int:
        held = self.folder.read()
        left = S.delete_by(held.where("document_id is not null"), documents, "document_id").unionByName(held.where("document_id is null"))
        before = held.count()
        self.folder.write(left.select(*held.columns))
        return before - self.folder.read().count()

    def drop(self) -> None:
        self.folder.drop()


class VectorStore:
    """Vectors of one kind (dense, sparse or hybrid) with a metric and a score convention."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "dense", dims: int = 64, metric: str = "ip", convention: str = "index"):
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        types = {"vector": "vector array<float>", "sparse_vector": "sparse_vector map<int,double>"}
        self.kind, self.dims, self.metric, self.convention = kind, dims, metric, convention
        self.folder = Folder(spark, path, "id bigint, document_id bigint, " + ", ".join(types[c] for c in KINDS[kind]))

    def all(self) -> DataFrame:
        return self.folder.read()

    def count(self) -> int:
        return self.all().count()

    def add(self, new: DataFrame) -> None:
        wanted = KINDS[self.kind]
        self.folder.write(add_vectors(self.all(), new, self.dims, "vector" in wanted, "sparse_vector" in wanted))

    def update(self, new: DataFrame) -> None:
        self.folder.write(S.update_by(self.all(), new, "id", [c for c in KINDS[self.kind] if c in new.columns], strict=True))

    def delete(self, ids: DataFrame) -> int:
        before = self.count()
        self.folder.write(S.delete_by(self.all(), ids, "id").select(*self.all().columns))
        return before - self.count()

    def clear(self) -> None:
        self.folder.write(self.all().limit(0))

    def drop(self) -> None:
        self.folder.drop()

    def search(self, queries: DataFrame, k: int = 3, documents: list[int] | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, id, rank, score); a threshold applies after the top k."""
        found = search_store(queries, self.all(), k, self.metric, documents)
        if "raw" in found.columns:
            raw = F.col("raw")
            if self.convention == "pg":
                raw = {"ip": -raw, "l2": F.sqrt(F.greatest(raw, F.lit(0.0))), "cosine": 1 - raw}[self.metric]
            found = found.withColumn("score", scale_score(raw, self.metric, self.convention))
        found = found.select("query_id", "id", "rank", "score")
        return found if threshold is None else found.where(F.col("score") >= threshold)

    def as_retriever(self, k: int = 3, threshold: float | None = None, documents: list[int] | None = None) -> Callable[[DataFrame], DataFrame]:
        return lambda queries: self.search(queries, k, documents, threshold)


#: Vector stores by name, with the score convention of each.
FACTORY = {"index": "index", "pg": "pg"}


def create_storage(spark: SparkSession, vector_type: str, path: str, **options) -> VectorStore:
    if vector_type not in FACTORY:
        raise ValueError(f"unknown vector store: {vector_type}")
    return VectorStore(spark, path, convention=FACTORY[vector_type], **options)
