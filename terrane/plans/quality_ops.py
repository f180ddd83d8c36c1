"""Metrics over the answer check, the evaluation items and the retrieved documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import quality as Q
from terrane.runtime import table


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "correctness_classifier").dropDuplicates(["pair_id"])


def check_answer(s, d):
    p = _pairs(s, d).select("pair_id", F.array_join("answer", " ").alias("a"), F.coalesce("ground_truth", F.array().cast("array<string>")).alias("g"))
    return p.select("pair_id", Q.answer_matches(F.col("a"), F.array_compact("g")).alias("correct"))


def _gold(s, d):
    return table(s, d, "eval_items").select(F.col("item_id").alias("item"), F.explode(T.sentences(F.col("passage"))).alias("fact"))


def _retrieved(s, d):
    """The documents of an item's language and topic stand-in: every document whose number falls on the item."""
    i = table(s, d, "eval_items").select(F.col("item_id").alias("item"))
    lo = i.agg(F.min("item").alias("lo"))
    docs = table(s, d, "documents").where("text is not null").join(F.broadcast(lo)).select((F.col("lo") + 3 * (F.col("doc_id") % 240)).alias("item"), "text")
    return docs.join(i, "item", "left_semi")


def check_hit(s, d):
    return Q.hits(_gold(s, d), _retrieved(s, d))


def micro_recall(s, d):
    h = Q.hits(_gold(s, d), _retrieved(s, d))
    return Q.aggregate(h.select((F.col("hits") > 0).alias("is_correct"), "hits", "total", (F.col("item") % 10).cast("double").alias("path_time"), (F.col("item") % 3).cast("double").alias("final_time")))


def _counters(s, d):
    a, g = F.coalesce("answer", F.array().cast("array<string>")), F.coalesce("ground_truth", F.array().cast("array<string>"))
    return _pairs(s, d).select("pair_id", F.size(a).alias("n"), F.size(F.filter(a, lambda x: ~F.coalesce(F.array_contains(g, x), F.lit(False)))).alias("x"), F.size(F.array_except(F.array_compact(g), F.array_compact(a))).alias("more"))


def prf1(s, d):
    p, r, f = Q.precision_recall_f1(F.col("n"), F.col("x"), F.col("more"))
    return _counters(s, d).select("pair_id", p.alias("p"), r.alias("r"), f.alias("f1"))


def macro_mean(s, d):
    return prf1(s, d).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p", "r", "f1")])


def context_precision(s, d):
    m = table(s, d, "mx_document").select("mx_id", F.from_json("metadata", "query_id bigint, retrieval_type string").alias("m")).where("m.query_id is not null")
    from pyspark.sql import Window

    r = m.select(F.col("m.query_id").alias("item"), F.row_number().over(Window.partitionBy("m.query_id").orderBy("mx_id")).alias("rank"), (F.coalesce(F.col("m.retrieval_type"), F.lit("")) == "both").cast("int").alias("relevant"))
    return Q.context_precision(r)


def entity_recall(s, d):
    p = _pairs(s, d).where("answer is not null and ground_truth is not null")
    return p.select("pair_id", F.round(Q.entity_recall(F.array_compact("answer"), F.array_compact("ground_truth")), 6).alias("recall"))


_N = r"CASE WHEN {0} IS NULL OR length({0}) > 10000 THEN '' ELSE array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ') END"
_P = "p AS (SELECT DISTINCT ON (pair_id) * FROM correctness_classifier)"
_SENTS = r"list_filter(list_transform(CASE WHEN length(passage) > 10000 THEN [passage] ELSE string_split(regexp_replace(passage, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: trim(x)), lambda x: x <> '')"
_HIT = f"g AS (SELECT item_id AS item, unnest({_SENTS}) AS fact FROM eval_items), gn AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY fact) AS n FROM g), r AS (SELECT (SELECT min(item_id) FROM eval_items) + 3 * (doc_id % 240) AS item, text FROM documents WHERE text IS NOT NULL AND text <> ''), f AS (SELECT DISTINCT gn.item, n FROM gn JOIN r USING (item) WHERE contains(text, fact) OR (contains(fact, text) AND length(text) > 0.5 * length(fact))), h AS (SELECT item, count(*) AS total, (SELECT count(*) FROM f WHERE f.item = g.item) AS hits FROM g GROUP BY 1)"
_PRF = _P + ", c AS (SELECT pair_id, len(coalesce(answer, [])) AS n, len(list_filter(coalesce(answer, []), lambda x: NOT coalesce(list_contains(coalesce(ground_truth, []), x), false))) AS x, len(list_filter(list_distinct(coalesce(ground_truth, [])), lambda x: NOT coalesce(list_contains(coalesce(answer, []), x), false))) AS more FROM p), q AS (SELECT pair_id, CASE WHEN n > 0 AND n > x THEN round_even((n - x) / n::DOUBLE, 4) END AS p, CASE WHEN n > 0 AND n > x THEN round_even((n - x) / (n - x + more)::DOUBLE, 4) END AS r FROM c), z AS (SELECT *, CASE WHEN p + r > 0 THEN round_even(2 * p * r / (p + r), 4) END AS f1 FROM q)"

SQL = {
    "check_answer": f"WITH {_P}, t AS (SELECT pair_id, {_N.format(chr(39) + chr(39) + ' || array_to_string(answer, ' + chr(39) + ' ' + chr(39) + ')')} AS a, list_transform(coalesce(ground_truth, []), lambda g: {_N.format('g')}) AS g FROM p) SELECT pair_id, len(list_filter(g, lambda x: x <> '' AND contains(a, x))) > 0 AS correct FROM t",
    "check_hit": f"WITH {_HIT} SELECT * FROM h",
    "micro_recall": f"WITH {_HIT} SELECT count(*) AS n, round(avg((hits > 0)::INT), 6) AS accuracy, round(sum(hits) / sum(total)::DOUBLE, 6) AS recall, round(avg(item % 10), 6) AS avg_path_time, round(avg(item % 3), 6) AS avg_final_time FROM h",
    "prf1": f"WITH {_PRF} SELECT pair_id, p, r, f1 FROM z",
    "macro_mean": f"WITH {_PRF} SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f1), 6) AS f1 FROM z",
    "context_precision": "WITH m AS (SELECT mx_id, metadata::JSON AS j FROM mx_document WHERE json_valid(metadata)), r AS (SELECT try_cast(j->>'query_id' AS BIGINT) AS item, row_number() OVER (PARTITION BY j->>'query_id' ORDER BY mx_id) AS rank, (coalesce(j->>'retrieval_type', '') = 'both')::INT AS relevant FROM m WHERE j->>'query_id' IS NOT NULL), a AS (SELECT *, sum(relevant) OVER (PARTITION BY item ORDER BY rank) / rank::DOUBLE AS p_at FROM r) SELECT item, round(coalesce(sum(p_at * relevant) / nullif(sum(relevant), 0), 0), 6) AS precision FROM a GROUP BY 1",
    "entity_recall": f"WITH {_P} SELECT pair_id, round(len(list_filter(list_distinct(ground_truth), lambda x: list_contains(answer, x))) / nullif(len(list_distinct(ground_truth)), 0)::DOUBLE, 6) AS recall FROM p WHERE answer IS NOT NULL AND ground_truth IS NOT NULL",
}
QUERIES = {k: globals()[k] for k in SQL}
