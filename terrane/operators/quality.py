"""Answer, retrieval and extraction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import normalize_text


def answer_matches(prediction: Column, truths: Column) -> Column:
    """Normalised equality, or a normalised truth contained in the prediction."""
    p = normalize_text(prediction)
    return F.coalesce(F.exists(truths, lambda g: (normalize_text(g) != "") & F.contains(p, normalize_text(g))), F.lit(False)) | F.coalesce(F.exists(truths, lambda g: normalize_text(g) == p) & (p != ""), F.lit(False))


def hits(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(item, hits, total): gold facts (item, fact) found in the item's retrieved texts (item, text): contained in one, or
    containing one longer than half of the fact. All facts count in the total."""
    g = gold.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy("fact")))
    pair = g.join(retrieved.where("text <> ''"), "item")
    found = pair.where((F.col("fact") != "") & (F.contains("text", "fact") | (F.contains("fact", "text") & (F.length("text") > 0.5 * F.length("fact"))))).select("item", "n").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("hits"))
    return gold.groupBy("item").agg(F.count(F.lit(1)).alias("total")).join(found, "item", "left").fillna(0, ["hits"])


def precision_recall_f1(n: Column, incorrect: Column, more: Column) -> tuple[Column, Column, Column]:
    """Rounded half to even at 4 digits; F1 from the rounded two; null without items or without a right one."""
    good = n - incorrect
    p = F.when((n > 0) & (good > 0), F.bround(good / n, 4))
    r = F.when((n > 0) & (good > 0), F.bround(good / (good + more), 4))
    return p, r, F.when(p + r > 0, F.bround(2 * p * r / (p + r), 4))


def context_precision(ranked: DataFrame) -> DataFrame:
    """(item, precision): mean of precision@k over the ranks of relevant contexts (item, rank, relevant 0/1)."""
    w = Window.partitionBy("item").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    p = ranked.withColumn("at", F.sum("relevant").over(w) / F.col("rank"))
    return p.groupBy("item").agg(F.round(F.coalesce(F.sum(F.col("at") * F.col("relevant")) / F.nullif(F.sum("relevant"), F.lit(0)), F.lit(0.0)), 6).alias("precision"))


def entity_recall(found: Column, wanted: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(found), F.array_distinct(wanted))) / F.nullif(F.size(F.array_distinct(wanted)), F.lit(0))


def aggregate(results: DataFrame) -> DataFrame:
    """Accuracy, micro recall and mean times over (is_correct, hits, total, path_time, final_time)."""
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("accuracy"),
        F.round(F.sum("hits") / F.sum("total"), 6).alias("recall"),
        F.round(F.avg("path_time"), 6).alias("avg_path_time"),
        F.round(F.avg("final_time"), 6).alias("avg_final_time"),
    )
