"""Answers of embedding and rerank services as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sparse_vector(answer: Column) -> Column:
    """[{"index": i, "value": v}, ...] as a map; of an index that occurs twice the last counts. An item without index or
    value fails the job, null stays null."""
    items = F.from_json(answer, "array<struct<index:int,value:double>>")
    bad = F.exists(items, lambda x: x.isNull() | x["index"].isNull() | x["value"].isNull())
    last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))), lambda y: y["index"] == x["index"]))
    whole = F.map_from_entries(F.transform(last, lambda x: F.struct(x["index"], x["value"])))
    return F.when(answer.isNotNull() & (items.isNull() | F.coalesce(bad, F.lit(False))), F.raise_error(F.lit("a sparse answer lacks index or value")).cast("map<int,double>")).otherwise(whole)


def dense_vectors(answer: Column) -> Column:
    """A list of vectors, or an object with data: [{"index": i, "embedding": [...]}], in the order of index."""
    plain = F.from_json(answer, "array<array<double>>")
    data = F.array_sort(F.from_json(F.get_json_object(answer, "$.data"), "array<struct<index:int,embedding:array<double>>>"))
    return F.when(F.trim(answer).startswith("["), plain).otherwise(F.transform(data, lambda x: x["embedding"]))


def rerank_scores(answer: Column, n: Column) -> Column:
    """[{"index": i, "score": s}, ...] in any order as n scores, 0 where one is missing. An index that is out of range or
    repeated fails the job."""
    items = F.from_json(answer, "array<struct<index:int,score:double>>")
    places = F.transform(items, lambda x: x["index"])
    wrong = F.exists(items, lambda x: x.isNull() | x["index"].isNull() | (x["index"] < 0) | (x["index"] >= n)) | (F.size(F.array_distinct(places)) < F.size(places))
    by_index = F.map_from_entries(F.transform(items, lambda x: F.struct(x["index"], x["score"])))
    scores = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(by_index[i], F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    return F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("a rerank answer has a wrong index")).cast("array<double>")).otherwise(scores)
