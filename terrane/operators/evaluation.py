"""Evaluating retrieval and answers item by item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import normalize_text, sentences
from terrane.operators.quality import answer_matches, hits


def supporting_sentences(paragraphs: Column) -> Column:
    """Sentences of the supporting paragraphs (is_supporting, paragraph_text), in order."""
    kept = F.filter(paragraphs, lambda p: F.coalesce(p["is_supporting"], F.lit(False)) & (F.coalesce(p["paragraph_text"], F.lit("")) != ""))
    return F.flatten(F.transform(kept, lambda p: sentences(p["paragraph_text"])))


def supporting_facts(context: Column, facts: Column) -> Column:
    """The sentences that facts (title, idx from 0) name in context (title, sentences); unknown titles and numbers are left
    out, of a title that occurs twice the last counts."""
    def one(f: Column) -> Column:
        held = F.element_at(F.concat(F.array(F.lit(None).cast("array<string>")), F.transform(F.filter(context, lambda c: c["title"] == f["title"]), lambda c: c["sentences"])), -1)
        return F.when(f["idx"] >= 0, F.get(held, f["idx"]))

    return F.filter(F.transform(facts, one), lambda x: x.isNotNull())


def question_of(item: Column) -> Column:
    """The `question` of an item (a map), or the first non-empty value whose key holds that word; '' without."""
    named = F.map_values(F.map_filter(item, lambda k, v: F.contains(F.lower(k), F.lit("question"))))
    return F.coalesce(F.nullif(item.getItem("question"), F.lit("")), F.get(named, F.lit(0)), F.lit(""))


def decoded(text: Column) -> Column:
    """ASCII text with \\uXXXX escapes written out; text in other characters, or with broken escapes, stays."""
    ascii_ = ~text.rlike(r"[^\x00-\x7f]")
    read = F.get(F.from_json(F.concat(F.lit('["'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"]')), "array<string>"), F.lit(0))
    return F.when(ascii_ & F.contains(text, F.lit("\\u")), F.coalesce(read, text)).otherwise(text)


def evaluate_items(items: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(item, is_correct, hits, total, recall) of items (item, prediction, answers ARRAY, facts ARRAY) and retrieved
    (item, text). Facts and texts are compared normalised; an item without facts has a recall of 0."""
    gold = items.select("item", F.explode("facts").alias("fact")).select("item", normalize_text(F.col("fact")).alias("fact"))
    got = retrieved.select("item", normalize_text(decoded(F.col("text"))).alias("text"))
    h = hits(gold, got)
    out = items.select("item", answer_matches(F.col("prediction"), F.col("answers")).alias("is_correct")).join(h, "item", "left").fillna(0, ["hits", "total"])
    return out.withColumn("recall", F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 6)).otherwise(0.0))


def share_of(found: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, share): how much of each item's wanted values was found, each value once; 0 where none was."""
    w = wanted.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    f = found.select(*keys, value).distinct().withColumn("_f", F.lit(1))
    return w.join(f, [*keys, value], "left").groupBy(*keys).agg(F.round(F.count("_f") / F.count(F.lit(1)), 6).alias("share"))


def reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """(item, value): one over the rank of the first relevant row of (item, rank, relevant 0/1), 0 without."""
    return ranked.groupBy("item").agg(F.round(F.coalesce(1 / F.min(F.when(F.col("relevant") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("value"))


def relevancy(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): mean of the scores of generated questions (or statements), those that are null counting 0."""
    return scores.groupBy(*keys).agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("value"))


def ranked_gain(ranked: DataFrame, k: int) -> DataFrame:
    """(item, value): normalised discounted gain of the first k rows (item, rank, relevant)."""
    ideal = Window.partitionBy("item").orderBy(F.col("relevant").desc(), "rank")
    gain = lambda at: F.col("relevant") / F.log2(at + 1)
    r = ranked.withColumn("best", F.row_number().over(ideal))
    sums = r.groupBy("item").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias("g"), F.sum(F.when(F.col("best") <= k, gain(F.col("best")))).alias("i"))
    return sums.select("item", F.round(F.coalesce(F.col("g") / F.nullif(F.col("i"), F.lit(0.0)), F.lit(0.0)), 6).alias("value"))


def _mean(verdicts: DataFrame) -> DataFrame:
    """(item, value): share of verdicts 1 of (item, verdict), nulls counting 0."""
    return verdicts.groupBy("item").agg(F.round(F.avg(F.coalesce(F.col("verdict").cast("double"), F.lit(0.0))), 6).alias("value"))


def _rated(greatest: float):
    """Mean of a judge's ratings from 0 to `greatest`, scaled to 1; ratings outside, and nulls, do not count."""

    def run(ratings: DataFrame) -> DataFrame:
        ok = F.when((F.col("rating") >= 0) & (F.col("rating") <= greatest), F.col("rating") / greatest)
        return ratings.groupBy("item").agg(F.round(F.avg(ok), 6).alias("value"))

    return run


def _correctness(counts: DataFrame) -> DataFrame:
    """(item, tp, fp, fn, similarity): three quarters F1 of statements, one quarter similarity."""
    f1 = F.col("tp") / F.nullif(F.col("tp") + 0.5 * (F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.select("item", F.round(0.75 * F.coalesce(f1, F.lit(0.0)) + 0.25 * F.coalesce("similarity", F.lit(0.0)), 6).alias("value"))


def _noise(claims: DataFrame) -> DataFrame:
    """(item, correct 0/1, supported 0/1): share of the claims that are wrong although a retrieved text supports them."""
    return claims.groupBy("item").agg(F.round(F.avg(((F.col("correct") == 0) & (F.col("supported") == 1)).cast("double")), 6).alias("value"))


def _relevant(questions: DataFrame) -> DataFrame:
    """(item, score, evasive 0/1): mean similarity of questions made from the answer, 0 if the answer evades."""
    return questions.groupBy("item").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))) * F.when(F.max("evasive") == 1, 0).otherwise(1), 6).alias("value"))


def _precision(ranked: DataFrame) -> DataFrame:
    from terrane.operators.quality import context_precision

    return context_precision(ranked).withColumnRenamed("precision", "value")


def _entities(pairs: DataFrame) -> DataFrame:
    from terrane.operators.quality import entity_recall

    return pairs.select("item", F.round(F.coalesce(entity_recall(F.col("found"), F.col("wanted")), F.lit(0.0)), 6).alias("value"))


#: The metrics by name: each takes the relation of the model's verdicts and gives (item, value).
METRICS = {
    "answer_correctness": _correctness,
    "answer_similarity": lambda d: d.select("item", F.round("similarity", 6).alias("value")),
    "answer_relevancy": _relevant,
    "context_precision": _precision,
    "context_recall": _mean,
    "context_entity_recall": _entities,
    "context_utilization": _precision,
    "faithfulness": _mean,
    "noise_sensitivity": _noise,
    "nv_accuracy": _rated(4.0),
    "nv_context_relevance": _rated(2.0),
    "nv_response_groundedness": _rated(2.0),
}


def metrics_of(names: list[str]) -> dict:
    """The known metrics among the names, once each in their order; none is an error."""
    found = {n: METRICS[n] for n in names if n in METRICS}
    if not found:
        raise ValueError("no known metric is asked for")
    return found


def evaluate(verdicts: dict[str, DataFrame]) -> DataFrame:
    """(item, metric, value) of every known metric with its verdicts."""
    out = None
    for name, f in metrics_of(list(verdicts)).items():
        part = f(verdicts[name]).select("item", F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out
