"""Chains: a cache before a model, summaries, reasoning paths step by step, and answers from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import clean_subquery, reasoning, truncate_middle
from terrane.operators.curation import indexed, user_prompt
from terrane.operators.ranking import first_seen
from terrane.runtime import materialize

ANSWER = "query string, result string, source_documents array<string>"


def cache_chain(queries: DataFrame, cache: DataFrame, chain: Callable[[DataFrame], DataFrame], to_cache: Callable[[Column], Column] | None = None, to_user: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): answers is (query, answer, hit), one row a query.

    cache is (query, answer) with answers as JSON texts of ANSWER. A hit gets its answer with the query replaced by the
    one asked, one that is no JSON object comes back as it stands. Misses go to `chain`, which gives (query, answer) in
    JSON, and are added to the cache. Null queries are left out.
    """
    q = queries.select("query").where("query is not null").distinct()
    found = q.join(first_seen(cache.select("query", "answer"), ["query"], ["answer"]), "query", "left")
    parsed = F.from_json("answer", ANSWER)
    named = F.to_json(F.struct(F.when(parsed["query"] != "", F.col("query")).otherwise(parsed["query"]).alias("query"), parsed["result"].alias("result"), parsed["source_documents"].alias("source_documents")))
    is_object = F.coalesce(F.trim("answer").startswith("{") & (parsed["query"].isNotNull() | parsed["result"].isNotNull()), F.lit(False))
    user = to_user or (lambda c: c)
    hits = found.where("answer is not null").select("query", F.when(is_object, user(named)).otherwise(F.col("answer")).alias("answer"), F.lit(True).alias("hit"))
    new = materialize(chain(found.where("answer is null").select("query")).select("query", "answer"), "asked")
    stored = new.select("query", (to_cache or (lambda c: c))(F.col("answer")).alias("answer"))
    return hits.unionByName(new.withColumn("hit", F.lit(False))), cache.select("query", "answer").unionByName(stored)


def summarize(texts: DataFrame, model: Callable[[Column], Column], shortest: int = 30) -> DataFrame:
    """`text` summarised where it is longer than `shortest`; others, and nulls, stay as they are."""
    return texts.withColumn("text", F.when(F.length("text") > shortest, model(F.col("text"))).otherwise(F.col("text")))


def step_prompt(question: Column, queries: Column, answers: Column, task: str) -> Column:
    """The task, the steps so far and the question for the next sub-query."""
    past = F.array_join(F.zip_with(queries, answers, lambda q, a: F.concat(F.lit("Intermediate query: "), q, F.lit("\nIntermediate answer: "), a)), "\n")
    return F.concat(F.lit(f"{task}\n"), past, F.lit("\n## Main question\n"), question)


def sample_paths(questions: DataFrame, model: Callable[[Column], Column], find: Callable[[DataFrame], DataFrame], answer: Callable[[Column], Column], task: str, length: int = 3, limit: int = 4096) -> DataFrame:
    """(item, question, subqueries, subanswers, documents, thoughts): up to `length` different sub-queries a question.

    Every round asks for all questions at once: the model gives the next sub-query, `find` gives (item, docs ARRAY) for
    (item, subquery), `answer` answers from them. A sub-query that came before adds nothing; a question is asked at most
    4 * length times. Rounds are written, so a lost executor repeats one round.
    """
    none = F.array().cast("array<string>")
    state = questions.select("item", "question", none.alias("subqueries"), none.alias("subanswers"), F.array().cast("array<array<string>>").alias("documents"), none.alias("thoughts"))
    for _ in range(4 * length):
        said = state.where(F.size("subqueries") < length).withColumn("_said", model(truncate_middle(step_prompt(F.col("question"), F.col("subqueries"), F.col("subanswers"), task), limit)))
        said = said.withColumn("_sub", clean_subquery(F.col("_said"))).withColumn("_thought", reasoning(F.col("_said")))
        asked = materialize(said.drop("_said"), "asked")
        if asked.isEmpty():
            break
        fresh = asked.where(~F.array_contains("subqueries", F.col("_sub")))
        if fresh.isEmpty():  # a model that is not deterministic may do better next time
            continue
        docs = find(fresh.select("item", F.col("_sub").alias("subquery"))).select("item", F.col("docs").alias("_docs"))
        done = fresh.join(docs, "item", "left").withColumn("_docs", F.coalesce("_docs", none))
        done = done.withColumn("_answer", answer(user_prompt(F.col("_sub"), F.col("_docs"), "")))
        add = lambda a, b: F.concat(a, F.array(F.col(b))).alias(a)
        done = done.select("item", "question", add("subqueries", "_sub"), add("subanswers", "_answer"), add("documents", "_docs"), add("thoughts", "_thought"))
        state = materialize(state.join(fresh.select("item"), "item", "left_anti").unionByName(done), "paths")
    return state


def final_answers(paths: DataFrame, model: Callable[[Column], Column], task: str, limit: int = 4096) -> DataFrame:
    """(item, answer) from the question, the steps and the documents of each path."""
    steps = F.array_join(F.zip_with("subqueries", "subanswers", lambda q, a: F.concat(F.lit("Query: "), q, F.lit("\nAnswer: "), a)), "\n")
    docs = indexed(F.array_distinct(F.flatten("documents")), "Doc")
    return paths.select("item", F.trim(model(truncate_middle(F.concat(F.lit(f"{task}\n"), docs, F.lit("\n"), steps, F.lit("\n"), F.col("question")), limit))).alias("answer"))


def naive_answers(questions: DataFrame, model: Callable[[Column], Column], limit: int = 4096) -> DataFrame:
    """(item, answer) of questions (item, question, docs ARRAY) from retrieved documents alone."""
    return questions.select("item", F.trim(model(truncate_middle(user_prompt(F.col("question"), F.col("docs"), ""), limit))).alias("answer"))
