"""Query-document pairs, prompts, reasoning paths and chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ranking import first_seen


def question_lines(text: Column) -> Column:
    """Questions of a generated text: labels stripped, empty lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:问题|Q|Question)\d*[：:]", "")))
    return F.filter(lines, lambda x: x != "")


def qd_pairs(docs: DataFrame, questions: Column) -> DataFrame:
    """(query, doc_id, pos): the first pair of each query."""
    p = docs.select("doc_id", F.posexplode(questions).alias("pos", "query"))
    return first_seen(p, ["query"], ["doc_id", "pos"])


def rewrites(pairs: DataFrame, n: int, rewrite: Callable[[Column, Column], Column]) -> DataFrame:
    """The original and n rewrites of each query beside their document; an empty rewrite drops its own row only."""
    p = pairs.withColumn("rewrite_no", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return p.withColumn("query", F.when(F.col("rewrite_no") == 0, F.col("query")).otherwise(rewrite(F.col("query"), F.col("rewrite_no")))).where("trim(query) <> ''")


def user_prompt(query: Column, docs: Column, prompt: str) -> Column:
    """Documents joined by blank lines, the prompt behind the last, then the query; without documents the query alone."""
    return F.when(F.size(docs) > 0, F.concat(F.array_join(docs, "\n\n"), F.lit(prompt), F.lit("\n\n"), query)).otherwise(query)


def indexed(items: Column, label: str) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def path_samples(paths: DataFrame) -> DataFrame:
    """(item, step, type, history, content) of paths (item, steps ARRAY): every non-blank step with the steps before it."""
    s = paths.select("item", F.posexplode("steps").alias("step", "content")).where("trim(content) <> ''")
    w = Window.partitionBy("item").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("item", "step", "content", F.array_join(F.collect_list("content").over(w), "\n").alias("history"))


def first_correct(attempts: DataFrame) -> DataFrame:
    """The first correct attempt of each item (item, attempt, correct)."""
    return first_seen(attempts.where("correct"), ["item"], ["attempt"])


def normal_results(payload: Column) -> Column:
    """Retrieval payloads as a list of texts: a JSON list, or an object with chunks, data, results, docs or passages."""
    listed = F.from_json(payload, "array<string>")
    inner = F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{k}"), "array<string>") for k in ("chunks", "data", "results", "docs", "passages")])
    return F.when(F.trim(payload).startswith("["), listed).otherwise(F.coalesce(inner, F.array(payload)))


def answer_chain(questions: DataFrame, found: DataFrame, generate: Callable[[Column], Column], prompt: str) -> DataFrame:
    """(query_id, query, result, source_documents): retrieved documents in rank order, a prompt, and the model's answer."""
    docs = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("docs"))
    q = questions.join(docs, "query_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    return q.select("query_id", "query", generate(user_prompt(F.col("query"), F.col("docs"), prompt)).alias("result"), F.col("docs").alias("source_documents"))


def pack_summaries(docs: DataFrame, summarize: Callable[[Column], Column], limit: int, rounds: int = 10) -> DataFrame:
    """(item, text): the texts of an item packed up to `limit`, summarised and packed again until one is left. A round's
    texts stay within their item; long items shrink by a factor each round."""
    from terrane.functions.text import greedy_groups
    from terrane.runtime import materialize

    t = docs.select("item", "pos", "text")
    for _ in range(rounds):
        g = t.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))
        if g.where("size(texts) > 1").isEmpty():
            break
        g = g.select("item", "texts", F.posexplode(greedy_groups(F.transform("texts", F.length), limit)).alias("pos", "g"))
        joined = F.array_join(F.slice("texts", F.col("g.start") + 1, F.greatest(F.col("g.end") - F.col("g.start"), F.lit(1))), "\n")
        t = materialize(g.select("item", "pos", summarize(joined).alias("text")), "summaries")
    return t.select("item", "text")
