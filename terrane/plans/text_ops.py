"""Text, table and JSON functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import ranking as R
from terrane.runtime import table


def row_linearize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", T.row_text(["p_name", "p_brand", "p_size"]).alias("text"))


def table_linearize(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.col("n_name"), F.col("n_regionkey").cast("string")))).alias("rows"))
    return n.select("n_regionkey", T.table_text(F.col("rows"), F.array(F.lit("name"), F.lit("region"))).alias("text"))


def excel_time(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.excel_time(F.col("l_discount")).alias("time"))


def blank_columns(s: SparkSession, d: str) -> DataFrame:
    """Per column of the registry the number of filled cells; a column of falsy cells only is blank."""
    t = table(s, d, "document_table")
    filled = [F.sum(F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0"), 1).otherwise(0)).alias(c) for c in ("document_name", "document_file_path", "knowledge_name")]
    return t.agg(*filled).unpivot([], ["document_name", "document_file_path", "knowledge_name"], "column_name", "filled").withColumn("blank", F.col("filled") == 0)


def strip_data_uri(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("text is not null").withColumn("t", F.concat("text", F.lit("\n![x](data:IMAGE/png;base64,AA)\nend")))
    return t.select("doc_id", F.md5(T.strip_data_images(F.col("t"))).alias("digest"))


def sentences(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("x"))
    return t.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


def truncate_head_tail(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("length(text) > 0").select("doc_id", F.md5(T.truncate_middle(F.col("text"), 101)).alias("digest"))


def greedy_pack(s: SparkSession, d: str) -> DataFrame:
    """Sentences of each passage packed into summary groups of at most 200 characters."""
    x = table(s, d, "eval_items").select("item_id", F.transform(T.sentences(F.col("passage")), F.length).alias("n"))
    return x.select("item_id", F.posexplode(T.greedy_groups(F.col("n"), 200)).alias("group_no", "g")).select("item_id", "group_no", "g.start", "g.end")


def numbered_lines(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("text is not null").select("doc_id", T.numbered_lines(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


def concept_parse(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "chunks_table").where("chunk_content is not null").select("chunk_id", T.concept_list(F.col("chunk_content")).alias("x"))
    return x.select("chunk_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest")).distinct()


def subquery_clean(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_items").select("item_id", F.concat(F.lit("<reasoning>"), "answer", F.lit("</reasoning><think>x</think> \"Step 2: "), "question", F.lit('"')).alias("t"))
    return q.select("item_id", T.clean_subquery(F.col("t")).alias("subquery"), T.reasoning(F.col("t")).alias("reasoning"))


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


def json_slice(s: SparkSession, d: str) -> DataFrame:
    """An answer with two markers; some have no brackets, some no marker."""
    lead = F.when(F.col("event_id") % 5 == 0, "no [mark] ").otherwise("result: [old] result: ")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "props")).otherwise(F.concat(F.lit("["), "props", F.lit("] done")))
    e = table(s, d, "events").select("event_id", F.concat(lead, body).alias("t"))
    return e.select("event_id", T.normal_json(T.json_array_text(F.col("t"), "result:"), True).alias("json"))


def json_value(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", T.json_value(F.col("props"), "k", "none").alias("k"), T.json_value(F.col("props"), "absent", "none").alias("absent"))


def parse_score(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.parse_score(F.concat(F.lit("score: "), F.col("l_tax").cast("string"))).alias("score"))


def judge_verdict(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select("item_id", T.verdict(F.concat(F.when(F.col("item_id") % 2 == 0, "well, yes. ").otherwise("No, not yes. "), "answer")).alias("yes"))


def valid_urls(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_table").select("document_id", F.concat(F.when(F.col("document_id") % 3 == 0, "ftp").otherwise("https"), F.lit("://host-1.example:80"), F.coalesce("document_file_path", F.lit(" x"))).alias("u"))
    return u.select("document_id", T.valid_url(F.col("u")).alias("valid")).distinct()


def qa_split(s: SparkSession, d: str) -> DataFrame:
    """Q<n>: blocks of a text that hold a reference passage."""
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.split("text", r"Q\d+[:：]").alias("p"))
    return t.select("doc_id", F.size(F.filter(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(1))), lambda x: F.contains(x, F.lit("参考段落")))).alias("n"))


def first_seen_dedup(s: SparkSession, d: str) -> DataFrame:
    """Global first-seen dedup of texts."""
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("digest"))
    return R.first_seen(t, ["digest"], ["doc_id"]).select("doc_id")


_SENT_LENGTHS = r"c AS (SELECT item_id, list_transform(list_filter(list_transform(CASE WHEN length(passage) > 10000 THEN [passage] ELSE string_split(regexp_replace(passage, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x)::INT) AS l FROM eval_items)"
_DOCS = "SELECT doc_id, {} FROM documents WHERE text IS NOT NULL"

QUERIES = {
    "row_linearize": row_linearize,
    "table_linearize": table_linearize,
    "excel_time": excel_time,
    "blank_columns": blank_columns,
    "strip_data_uri": strip_data_uri,
    "sentences": sentences,
    "truncate_head_tail": truncate_head_tail,
    "greedy_pack": greedy_pack,
    "numbered_lines": numbered_lines,
    "concept_parse": concept_parse,
    "subquery_clean": subquery_clean,
    "normalize_text": normalize_text,
    "json_slice": json_slice,
    "json_value": json_value,
    "parse_score": parse_score,
    "judge_verdict": judge_verdict,
    "valid_urls": valid_urls,
    "qa_split": qa_split,
    "first_seen_dedup": first_seen_dedup,
}
SQL = {
    "row_linearize": "SELECT p_partkey, concat_ws(';', 'p_name:' || nullif(p_name, ''), 'p_brand:' || nullif(p_brand, ''), 'p_size:' || nullif(p_size::VARCHAR, '0')) || ';' AS text FROM part",
    "table_linearize": "SELECT n_regionkey, string_agg('name: ' || n_name || '，region: ' || n_regionkey, '；' ORDER BY n_name) || '。' AS text FROM nation GROUP BY 1",
    "excel_time": "SELECT l_orderkey, l_linenumber, strftime(epoch_ms((round(l_discount * 86400) * 1000)::BIGINT), '%H:%M') AS time FROM lineitem",
    "blank_columns": "WITH c AS (SELECT 'document_name' AS column_name, count(nullif(nullif(document_name, ''), '0')) AS filled FROM document_table UNION ALL SELECT 'document_file_path', count(nullif(nullif(document_file_path, ''), '0')) FROM document_table UNION ALL SELECT 'knowledge_name', count(nullif(nullif(knowledge_name, ''), '0')) FROM document_table) SELECT *, filled = 0 AS blank FROM c",
    "strip_data_uri": _DOCS.format("md5(array_to_string(list_filter(string_split(text || chr(10) || '![x](data:IMAGE/png;base64,AA)' || chr(10) || 'end', chr(10)), lambda x: NOT contains(lower(x), 'data:image')), chr(10))) AS digest"),
    "sentences": r"WITH c AS (SELECT doc_id, list_filter(list_transform(CASE WHEN length(text) > 10000 THEN [text] ELSE string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: CASE WHEN length(text) > 10000 THEN x ELSE regexp_replace(x, '^\s+|\s+$', '', 'g') END), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS digest FROM c",
    "truncate_head_tail": "WITH c AS (SELECT doc_id, text, CASE WHEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) / length(text)::DOUBLE > 0.5 THEN 101 ELSE 202 END AS n FROM documents WHERE length(text) > 0) SELECT doc_id, md5(CASE WHEN length(text) <= n THEN text ELSE substr(text, 1, n // 2) || right(text, n - n // 2) END) AS digest FROM c",
    "greedy_pack": "WITH RECURSIVE " + _SENT_LENGTHS + ", w AS (SELECT item_id, l, 0 AS i, 0 AS start, 0 AS total, NULL::INT AS from_, NULL::INT AS to_ FROM c UNION ALL SELECT item_id, l, i + 1, CASE WHEN total + l[i + 1] > 200 AND i > start THEN i ELSE start END, CASE WHEN total + l[i + 1] > 200 AND i > start THEN l[i + 1] ELSE total + l[i + 1] END, CASE WHEN total + l[i + 1] > 200 AND i > start THEN start END, CASE WHEN total + l[i + 1] > 200 AND i > start THEN i END FROM w WHERE i < len(l)), g AS (SELECT item_id, from_ AS start, to_ AS stop FROM w WHERE from_ IS NOT NULL UNION ALL SELECT item_id, start, i FROM w WHERE i = len(l) AND i > start) SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY start) - 1)::INT AS group_no, start, stop AS \"end\" FROM g",
    "numbered_lines": r"WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '^[0-9]')) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS digest FROM c",
    "concept_parse": r"WITH c AS (SELECT chunk_id, list_filter(list_transform(string_split(chunk_content, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM chunks_table WHERE chunk_content IS NOT NULL), u AS (SELECT chunk_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM c) SELECT DISTINCT chunk_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS digest FROM u",
    "subquery_clean": "SELECT item_id, question AS subquery, trim(answer) AS reasoning FROM eval_items",
    "normalize_text": r"SELECT doc_id, md5(CASE WHEN text IS NULL OR length(text) > 10000 THEN '' ELSE array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ') END) AS digest FROM documents",
    "json_slice": r"WITH p AS (SELECT event_id, replace(regexp_replace(props, '\s', '', 'g'), chr(39), chr(34)) AS p FROM events) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 THEN p ELSE '[' || p || ']' END AS json FROM p",
    "json_value": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events",
    "parse_score": r"SELECT l_orderkey, l_linenumber, coalesce(nullif(regexp_extract('score: ' || l_tax::VARCHAR, '(1(\.0{1,2})?|0(\.\d{1,2})?)', 1), '')::DOUBLE, 0) AS score FROM lineitem",
    "judge_verdict": "WITH t AS (SELECT item_id, upper(CASE WHEN item_id % 2 = 0 THEN 'well, yes. ' ELSE 'No, not yes. ' END || answer) AS t FROM eval_items) SELECT item_id, starts_with(t, 'YES') OR (strpos(t, 'YES') > 0 AND (strpos(t, 'NO') = 0 OR strpos(t, 'YES') < strpos(t, 'NO'))) AS yes FROM t",
    "valid_urls": r"SELECT DISTINCT document_id, regexp_matches(CASE WHEN document_id % 3 = 0 THEN 'ftp' ELSE 'https' END || '://host-1.example:80' || coalesce(document_file_path, ' x'), '^https?://[A-Za-z0-9][A-Za-z0-9.\-]*(:\d{1,5})?(/\S*)?$') AS valid FROM document_table",
    "qa_split": r"SELECT doc_id, len(list_filter(string_split_regex(text, 'Q\d+[:：]')[2:], lambda x: contains(x, '参考段落')))::INT AS n FROM documents WHERE text IS NOT NULL",
    "first_seen_dedup": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY md5(text)",
}
