"""Uploading files into a knowledge base: registry, chunks and vectors change together or, for a file that fails, not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ranking import first_seen, numbered
from terrane.runtime import materialize

REASONS = ("unreadable", "exists", "empty", "embedding")


def upload(
    files: DataFrame,
    registry: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    knowledge_id: int,
    split: Callable[[Column], Column],
    embed: Callable[[Column], Column],
    dims: int,
    force: bool = False,
) -> dict[str, DataFrame]:
    """The new registry, chunks and vectors, and `failed` (document_name, reason).

    files is (document_name, path, text); registry (document_id, knowledge_id, document_name, path); chunks (chunk_id,
    document_id, document_name, content); vectors (id, document_id, vector). A file fails if its text is null, if its name
    is in the base (with `force` it replaces that document), if it gives no pieces, or if the vector of any of its pieces
    is missing or has not `dims` finite numbers. Of files of one name in an upload the first counts (with `force` the
    last), the others exist already. Ids continue the greatest ones in the order of names and pieces. Rows without a name
    are left out.
    """
    f = files.where("document_name is not null").select("document_name", "path", "text")
    base = registry.where(F.col("knowledge_id") == knowledge_id).select("document_name", "document_id").where("document_name is not null")
    once = first_seen(f, ["document_name"], ["path"], last=force)
    twice = f.groupBy("document_name").count().where("count > 1")
    known = once.join(base.select("document_name").distinct(), "document_name", "left_semi")
    unread = once.where("text is null")
    taken = once.where("text is not null")
    if not force:
        taken = taken.join(known.select("document_name"), "document_name", "left_anti")
    pieces = taken.select("document_name", F.posexplode_outer(split(F.col("text"))).alias("pos", "content"))
    pieces = materialize(pieces.withColumn("vector", F.when(F.col("content").isNotNull(), embed(F.col("content")))), "pieces")
    empty = pieces.where("content is null").select("document_name").distinct()
    sound = F.coalesce((F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    wrong = pieces.where(F.col("content").isNotNull() & ~sound).select("document_name").distinct()
    bad = empty.unionByName(wrong)
    good = taken.join(bad, "document_name", "left_anti").select("document_name", "path")

    top = registry.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("top"))
    new = numbered(good, [F.col("document_name")], "_n").join(F.broadcast(top)).select((F.col("top") + F.col("_n")).alias("document_id"), F.lit(knowledge_id).cast("bigint").alias("knowledge_id"), "document_name", "path")
    new = materialize(new, "registry")
    # chunk ids: counted per document, then within it
    sizes = pieces.join(new.select("document_name", "document_id"), "document_name").groupBy("document_id", "document_name").agg(F.count(F.lit(1)).alias("_size"))
    first = numbered(sizes, [F.col("document_id")], "_n")
    ahead = _running(first, "_n", "_size")
    last = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0)).alias("top"))
    placed = pieces.join(ahead.select("document_name", "document_id", "_before"), "document_name").join(F.broadcast(last)).withColumn("chunk_id", F.col("top") + F.col("_before") + F.col("pos") + 1)
    placed = materialize(placed.select("chunk_id", "document_id", "document_name", "content", "vector"), "placed")

    gone = base.join(good.select("document_name"), "document_name", "left_semi").select("document_id").distinct() if force else None
    keep = lambda df: df if gone is None else df.join(gone, "document_id", "left_anti")
    old = registry if gone is None else registry.join(gone.withColumn("knowledge_id", F.lit(knowledge_id).cast("bigint")), ["document_id", "knowledge_id"], "left_anti")
    why = lambda df, reason: df.select("document_name", F.lit(reason).alias("reason"))
    failed = why(unread, "unreadable").unionByName(why(empty, "empty")).unionByName(why(wrong, "embedding")).unionByName(why(twice, "exists"))
    if not force:
        failed = failed.unionByName(why(known.where("text is not null"), "exists"))
    return {
        "registry": old.select(*registry.columns).unionByName(new, allowMissingColumns=True),
        "chunks": keep(chunks).unionByName(placed.drop("vector"), allowMissingColumns=True),
        "vectors": keep(vectors).unionByName(placed.select(F.col("chunk_id").alias("id"), "document_id", F.col("vector").cast("array<float>").alias("vector")), allowMissingColumns=True),
        "failed": failed.distinct(),
    }


def _running(df: DataFrame, order: str, size: str, block: int = 100_000) -> DataFrame:
    """`_before`: the sum of `size` of the rows before, in two levels, so no task sees all rows."""
    d = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = d.groupBy("_block").agg(F.sum(size).alias("_s")).withColumn("_lead", F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(sums.select("_block", "_lead")), "_block").withColumn("_before", F.col("_lead") + own).drop("_block", "_lead")


def add_vectors(store: DataFrame, new: DataFrame, dims: int, dense: bool = True, sparse: bool = False) -> DataFrame:
    """Adds rows (id, document_id, vector and/or sparse_vector) to a store of the given kind. Ids must be new and unique; a
    dense store wants `dims` finite numbers, a sparse one non-negative indices; other columns than the kind's are refused."""
    wanted = ({"vector"} if dense else set()) | ({"sparse_vector"} if sparse else set())
    if not wanted or wanted != {"vector", "sparse_vector"} & set(new.columns):
        raise ValueError(f"this store takes {', '.join(sorted(wanted)) or 'nothing'}")
    ok = F.lit(True)
    if dense:
        ok = ok & F.coalesce((F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    if sparse:
        ok = ok & F.coalesce(F.forall(F.map_keys("sparse_vector"), lambda k: k >= 0), F.lit(False))
    # one pass: wrong rows, repeated ids and ids that are there
    seen = new.withColumn("_ok", ok).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_ok").cast("int")).alias("ok")).join(store.select("id").distinct().withColumn("there", F.lit(1)), "id", "left")
    if not seen.where("ok = 0 or n > 1 or there = 1 or id is null").isEmpty():
        raise ValueError("a vector is malformed, or its id is null, repeated or there already")
    return store.unionByName(new, allowMissingColumns=True)


def search_store(queries: DataFrame, store: DataFrame, k: int, metric: str = "ip", documents: list[int] | None = None) -> DataFrame:
    """Dense or sparse search by what the queries hold (vector or sparse); a document filter applies before the top k."""
    from terrane.operators.vectors import knn, sparse_knn

    held = store if documents is None else store.where(F.col("document_id").isin(documents))
    if "vector" in queries.columns:
        return knn(queries, held, k, metric)
    return sparse_knn(queries, held.withColumnRenamed("sparse_vector", "sparse"), k)
