"""Full-text and pair scoring over the documents, with eval questions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import lexical as L
from terrane.runtime import materialize, spread, table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text", "lang"), "doc_id")


def _questions(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_items")
    return q.select(F.col("item_id").alias("query_id"), F.explode(L.word_tokens(F.col("question"))).alias("term"))


def _store(s: SparkSession, d: str, cut: str | None = None) -> DataFrame:
    docs = _docs(s, d)
    return L.bm25_store(_questions(s, d), docs, L.word_tokens(F.col("text")), 3, docs.where(cut) if cut else None)


def bm25_store_topk(s: SparkSession, d: str) -> DataFrame:
    return _store(s, d).withColumn("retrieval_type", F.lit("sparse"))


def bm25_store_filtered(s: SparkSession, d: str) -> DataFrame:
    return _store(s, d, "lower(trim(lang)) = 'en'")


def bm25_comma_tokens(s: SparkSession, d: str) -> DataFrame:
    """The keyword retriever's default tokenizer splits both sides on commas."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("l")).select("doc_id", F.concat_ws(",", "s", "l", F.concat("s", F.lit("/"), "l")).alias("text"))
    tokens = L.comma_tokens(F.col("text"))
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(tokens).alias("term"))
    return L.bm25_store(q, docs, tokens, 1)


def bm25_pair_okapi(s: SparkSession, d: str) -> DataFrame:
    """Each item's question against its own passage, in the corpus of passages."""
    items = table(s, d, "eval_items").select(F.col("item_id").alias("doc_id"), "question", "passage")
    tokens = L.word_tokens(F.col("passage"))
    q = items.select(F.col("doc_id").alias("query_id"), "doc_id", F.explode(L.word_tokens(F.col("question"))).alias("term"))
    return L.bm25_pairs(q, materialize(L.postings(items, tokens), "postings"), L.corpus_stats(items, tokens))


def term_postings(s: SparkSession, d: str) -> DataFrame:
    post = L.postings(_docs(s, d), L.word_tokens(F.col("text")))
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _tok(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({c}), '(\\p{{Han}})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


_POST = "t AS (SELECT doc_id, {tok} AS toks FROM {src}), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t WHERE toks IS NOT NULL), p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t) GROUP BY 1, 2)"
_TF = "tf * {k1p} / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))"
_TOP = (
    "WITH " + _POST + ", q AS ({q}), f AS (SELECT * FROM p {cut}), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), "
    "s AS (SELECT q.query_id, f.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * " + _TF.format(k1=1.2, k1p=2.2) + "), 5) AS score FROM q JOIN f USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank{extra} FROM r WHERE rank <= {k}"
)
_Q = f"SELECT DISTINCT item_id AS query_id, unnest({_tok('question')}) AS term FROM eval_items"
_COMMA = "(SELECT doc_id, concat_ws(',', coalesce(source, ''), coalesce(lang, ''), coalesce(source, '') || '/' || coalesce(lang, '')) AS text FROM documents)"
_CTOK = r"list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_ITEMS = "(SELECT item_id AS doc_id, passage AS text FROM eval_items)"

QUERIES = {
    "bm25_store_topk": bm25_store_topk,
    "bm25_store_filtered": bm25_store_filtered,
    "bm25_comma_tokens": bm25_comma_tokens,
    "bm25_pair_okapi": bm25_pair_okapi,
    "term_postings": term_postings,
}
SQL = {
    "bm25_store_topk": _TOP.format(tok=_tok("text"), src="documents", q=_Q, cut="", k=3, extra=", 'sparse' AS retrieval_type"),
    "bm25_store_filtered": _TOP.format(tok=_tok("text"), src="documents", q=_Q, cut="WHERE doc_id IN (SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'en')", k=3, extra=""),
    "bm25_comma_tokens": _TOP.format(tok=_CTOK, src=_COMMA, q=f"SELECT DISTINCT doc_id AS query_id, unnest({_CTOK}) AS term FROM {_COMMA} WHERE doc_id % 100 = 0", cut="", k=1, extra=""),
    "bm25_pair_okapi": "WITH "
    + _POST.format(tok=_tok("text"), src=_ITEMS)
    + f", q AS (SELECT item_id AS query_id, unnest({_tok('question')}) AS term FROM eval_items), df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p CROSS JOIN st GROUP BY term, n), m AS (SELECT avg(raw) AS mean FROM df), s AS (SELECT q.query_id, sum(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * "
    + _TF.format(k1=1.5, k1p=2.5)
    + ") AS s FROM q JOIN p ON p.doc_id = q.query_id AND p.term = q.term JOIN df ON df.term = q.term CROSS JOIN m CROSS JOIN st GROUP BY 1) SELECT i.query_id, i.query_id AS doc_id, round(coalesce(s, 0), 5) AS score FROM (SELECT DISTINCT query_id FROM q) i LEFT JOIN s USING (query_id)",
    "term_postings": "WITH " + _POST.format(tok=_tok("text"), src="documents") + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY 1",
}
