"""Uploads into the knowledge base, sheets as text, vector stores and sealed columns over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators import evaluation as V
from terrane.operators import ingest as I
from terrane.operators import sheets as S
from terrane.operators import stores as C
from terrane.runtime import table

BASE = 3


def _upload(s: SparkSession, d: str, force: bool) -> dict[str, DataFrame]:
    """One file per document name of the retrieved documents, its text that of the least id. Pieces have 400 characters, the
    embedding is (length, 1) and broken for last pieces of a length divisible by 7."""
    reg = table(s, d, "document_table").select("document_id", "knowledge_id", "document_name", F.col("document_file_path").alias("path")).distinct()
    chunks = table(s, d, "chunks_table").select("chunk_id", "document_id", "document_name", F.md5("chunk_content").alias("content")).distinct()
    vectors = table(s, d, "dense_model").select("id", "document_id", F.col("vector").cast("array<float>").alias("vector"))
    files = table(s, d, "mx_document").where("document_name is not null").groupBy("document_name").agg(F.min_by("page_content", "mx_id").alias("text"), F.min("mx_id").cast("string").alias("path"))
    split = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / 400).cast("int")), lambda i: F.substring(t, i * 400 + 1, F.lit(400))))
    embed = lambda t: F.array(F.when((F.length(t) < 400) & (F.length(t) % 7 == 0), F.lit(float("nan"))).otherwise(F.length(t).cast("double")), F.lit(1.0))
    return I.upload(files, reg, chunks, vectors, BASE, split, embed, 2, force)


def upload_chunks(s, d):
    """Per uploaded document its id, the range of its chunks, and the sum of their vectors."""
    r = _upload(s, d, False)
    new = r["chunks"].join(F.broadcast(table(s, d, "chunks_table").agg(F.max("chunk_id").alias("top")))).where("chunk_id > top")
    v = r["vectors"].where("size(vector) = 2").select(F.col("id").alias("chunk_id"), F.get("vector", F.lit(0)).cast("bigint").alias("len"))
    return new.join(v, "chunk_id").groupBy("document_id", "document_name").agg(F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"), F.sum("len").alias("len"))


def upload_failed(s, d):
    return _upload(s, d, False)["failed"]


def upload_forced(s, d):
    """Sizes of registry and stores after an upload that replaces documents."""
    r = _upload(s, d, True)
    n = lambda k: r[k].agg(F.lit(k).alias("store"), F.count(F.lit(1)).alias("n"))
    return n("registry").unionByName(n("chunks")).unionByName(n("vectors"))


def _sheets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A sheet a region: titles in row 3, a nation in every second row below; the region's name merged over all of them."""
    n = table(s, d, "nation").withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).withColumn("row", 2 + 2 * F.col("k"))
    sheet = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("sheet")
    cell = lambda df, row, col, value: df.select(sheet, row.cast("int").alias("row"), F.lit(col).alias("col"), value.alias("value"))
    heads = n.select("n_regionkey").distinct()
    cells = [cell(heads, F.lit(3), c, F.lit(v)) for c, v in ((2, " name"), (3, "region"), (4, ""), (5, "key"))]
    cells += [cell(n, F.col("row"), 2, F.col("n_name")), cell(n.where("k = 1"), F.col("row"), 3, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))), cell(n, F.col("row"), 5, F.col("n_nationkey").cast("string"))]
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    merges = n.groupBy("n_regionkey").agg(F.min("row").cast("int").alias("top"), F.max("row").cast("int").alias("bottom")).select(sheet, "top", "bottom", F.lit(3).alias("left"), F.lit(3).alias("right"))
    return out, merges


def sheet_rows(s, d):
    return S.sheet_lines(*_sheets(s, d), ["sheet"])


def sheet_blank_rows(s, d):
    return S.blank_lines(_sheets(s, d)[0], ["sheet"], "row")


def sheet_blank_columns(s, d):
    return S.blank_lines(_sheets(s, d)[0], ["sheet"], "col")


def sheet_bounds(s, d):
    return S.bounds(_sheets(s, d)[0], ["sheet"])


def vector_add(s, d):
    """The hybrid rows added to the dense store under new ids."""
    store = table(s, d, "dense_model").select("id", "document_id", "vector")
    top = store.agg(F.max("id").alias("top"))
    h = table(s, d, "hybrid_model").where("size(vector) = 64 and not exists(vector, x -> isnan(x))").join(F.broadcast(top)).select((F.col("id") + F.col("top")).alias("id"), "document_id", "vector")
    return I.add_vectors(store, h, 64).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def store_search_documents(s, d):
    """Sparse search among the rows of some documents only."""
    h = table(s, d, "hybrid_model").select("id", "document_id", "sparse_vector")
    q = h.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("sparse_vector").alias("sparse"))
    ids = [r[0] for r in h.where("document_id > 0").groupBy("document_id").count().orderBy(F.col("count").desc(), "document_id").limit(20).collect()]
    return I.search_store(q, h, 3, documents=ids)


def chunk_sealed(s, d):
    """Contents sealed by a cipher (base64 here) when stored, opened when looked up."""
    c = table(s, d, "chunks_table").select("chunk_id", "chunk_content").where("chunk_content is not null").distinct()
    sealed = C.apply_cipher(c, ["chunk_content"], lambda x: F.base64(F.encode(x, "UTF-8")))
    opened = C.apply_cipher(sealed, ["chunk_content"], lambda x: F.decode(F.unbase64(x), "UTF-8"))
    return opened.join(sealed.select("chunk_id", F.col("chunk_content").alias("held")), "chunk_id").where("held <> chunk_content").select("chunk_id", F.md5("chunk_content").alias("content")).distinct()


def golden_paragraphs(s, d):
    p = F.array(F.struct(F.lit(True).alias("is_supporting"), F.col("passage").alias("paragraph_text")), F.struct(F.lit(False).alias("is_supporting"), F.col("question").alias("paragraph_text")), F.struct(F.lit(None).cast("boolean").alias("is_supporting"), F.col("answer").alias("paragraph_text")))
    return table(s, d, "eval_items").select("item_id", F.posexplode(V.supporting_sentences(p)).alias("pos", "fact"))


def golden_facts(s, d):
    c = F.array(F.struct(F.col("task").alias("title"), F.array("question", "answer").alias("sentences")))
    f = F.array(*[F.struct(t.alias("title"), F.lit(i).alias("idx")) for t, i in ((F.col("task"), 1), (F.col("task"), 0), (F.col("task"), 5), (F.lit("?"), 0), (F.col("task"), -1))])
    return table(s, d, "eval_items").select("item_id", F.posexplode(V.supporting_facts(c, f)).alias("pos", "fact"))


def question_of(s, d):
    named = F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("question"), F.col("question"))).otherwise(F.create_map(F.lit("id"), F.lit("1"), F.lit("Main_Question"), F.col("task")))
    return table(s, d, "eval_items").select("item_id", V.question_of(named).alias("question"))


def decoded(s, d):
    t = F.concat(F.lit("caf\\u00e9 \\u4e2d "), F.translate("task", '"\\', ""))
    return table(s, d, "eval_items").select("item_id", V.decoded(F.when(F.col("item_id") % 3 == 0, F.concat(t, F.lit("é"))).otherwise(t)).alias("text"))


def evaluate_items(s, d):
    """The answer is the prediction; the facts are the passage's sentences and one that is not there."""
    from terrane.functions.text import sentences

    e = table(s, d, "eval_items")
    items = e.select(F.col("item_id").alias("item"), F.when(F.col("item_id") % 4 == 0, "wrong").otherwise(F.col("answer")).alias("prediction"), F.array("answer").alias("answers"), F.concat(sentences(F.col("passage")), F.array(F.lit("zzzz zzzz"))).alias("facts"))
    return V.evaluate_items(items, e.select(F.col("item_id").alias("item"), F.col("passage").alias("text"))).select("item", "is_correct", "total")


def _ranked(s, d):
    m = table(s, d, "mx_document").select("mx_id", F.get_json_object("metadata", "$.query_id").cast("bigint").alias("item")).where("item is not null")
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("mx_id"))).withColumn("relevant", (F.col("mx_id") % 3 == 0).cast("int"))


def reciprocal_rank(s, d):
    return V.reciprocal_rank(_ranked(s, d))


def ranked_gain(s, d):
    return V.ranked_gain(_ranked(s, d), 5)


def relevancy(s, d):
    return V.relevancy(_ranked(s, d).withColumn("score", F.when(F.col("rank") % 2 == 0, F.col("relevant").cast("double"))), ["item"])


def retrieval_share(s, d):
    r = _ranked(s, d)
    return V.share_of(r.where("rank <= 4"), r.where("relevant = 1"), ["item"], "mx_id")


_PART = "reg AS (SELECT DISTINCT document_id, knowledge_id, document_name, document_file_path FROM document_table), base AS (SELECT DISTINCT document_id, document_name FROM reg WHERE knowledge_id = 3 AND document_name IS NOT NULL)"
_FILES = "f AS (SELECT document_name, page_content AS text FROM (SELECT *, row_number() OVER (PARTITION BY document_name ORDER BY page_content IS NULL, mx_id) AS k FROM mx_document WHERE document_name IS NOT NULL) WHERE k = 1)"
_GOOD = "g AS (SELECT document_name, text, length(text) AS n FROM f WHERE length(text) > 0 AND NOT (length(text) % 400 > 0 AND length(text) % 400 % 7 = 0) {known})"
_KNOWN = "AND document_name NOT IN (SELECT document_name FROM base)"
_SH = "n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)"
_RANKED = "r AS (SELECT mx_id, item, row_number() OVER (PARTITION BY item ORDER BY mx_id) AS rank, (mx_id % 3 = 0)::INT AS relevant FROM (SELECT mx_id, try_cast(metadata::JSON->>'query_id' AS BIGINT) AS item FROM mx_document WHERE json_valid(metadata)) WHERE item IS NOT NULL)"
_SPLIT = r"list_filter(list_transform(CASE WHEN length(passage) > 10000 THEN [passage] ELSE string_split(regexp_replace(passage, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: trim(x)), lambda x: x <> '')"

QUERIES = {
    "upload_chunks": upload_chunks, "upload_failed": upload_failed, "upload_forced": upload_forced, "sheet_rows": sheet_rows, "sheet_blank_rows": sheet_blank_rows, "sheet_blank_columns": sheet_blank_columns, "sheet_bounds": sheet_bounds,
    "vector_add": vector_add, "store_search_documents": store_search_documents, "chunk_sealed": chunk_sealed, "golden_paragraphs": golden_paragraphs, "golden_facts": golden_facts, "question_of": question_of, "decoded": decoded,
    "evaluate_items": evaluate_items, "reciprocal_rank": reciprocal_rank, "ranked_gain": ranked_gain, "relevancy": relevancy, "retrieval_share": retrieval_share,
}
SQL = {
    "upload_chunks": f"WITH {_PART}, {_FILES}, {_GOOD.format(known=_KNOWN)}, o AS (SELECT *, row_number() OVER (ORDER BY document_name) AS k, (n + 399) // 400 AS c FROM g), b AS (SELECT *, sum(c) OVER (ORDER BY k) AS upto FROM o) SELECT (SELECT max(document_id) FROM reg) + k AS document_id, document_name, (SELECT max(chunk_id) FROM chunks_table) + (upto - c)::BIGINT + 1 AS first, (SELECT max(chunk_id) FROM chunks_table) + upto::BIGINT AS last, n::BIGINT AS len FROM b",
    "upload_failed": f"WITH {_PART}, {_FILES}, x AS (SELECT document_name, text, document_name IN (SELECT document_name FROM base) AS known FROM f) SELECT document_name, 'unreadable' AS reason FROM x WHERE text IS NULL UNION SELECT document_name, 'exists' FROM x WHERE text IS NOT NULL AND known UNION SELECT document_name, 'empty' FROM x WHERE text = '' AND NOT known UNION SELECT document_name, 'embedding' FROM x WHERE length(text) % 400 > 0 AND length(text) % 400 % 7 = 0 AND NOT known",
    "upload_forced": f"WITH {_PART}, {_FILES}, {_GOOD.format(known='')}, gone AS (SELECT document_id FROM base WHERE document_name IN (SELECT document_name FROM g)), c AS (SELECT DISTINCT chunk_id, document_id, document_name, md5(chunk_content) FROM chunks_table) SELECT 'registry' AS store, (SELECT count(*) FROM reg WHERE NOT (knowledge_id = 3 AND coalesce(document_id IN (SELECT document_id FROM gone), false))) + (SELECT count(*) FROM g) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM c WHERE NOT coalesce(document_id IN (SELECT document_id FROM gone), false)) + (SELECT sum((n + 399) // 400) FROM g)::BIGINT UNION ALL SELECT 'vectors', (SELECT count(*) FROM dense_model WHERE NOT coalesce(document_id IN (SELECT document_id FROM gone), false)) + (SELECT sum((n + 399) // 400) FROM g)::BIGINT",
    "sheet_rows": f"WITH {_SH} SELECT 'r' || n_regionkey AS sheet, (2 + 2 * k)::INT AS row, 'name:' || n_name || ';region:R' || n_regionkey || ';' || CASE WHEN n_nationkey <> 0 THEN 'key:' || n_nationkey || ';' ELSE '' END AS text FROM n",
    "sheet_blank_rows": f"WITH {_SH}, t AS (SELECT n_regionkey, max(2 + 2 * k) AS last FROM n GROUP BY 1), a AS (SELECT n_regionkey, unnest(range(1, last + 1)) AS row FROM t) SELECT 'r' || n_regionkey AS sheet, row::INT AS row FROM a WHERE row <> 3 AND NOT (row >= 4 AND row % 2 = 0)",
    "sheet_blank_columns": "SELECT 'r' || r_regionkey AS sheet, unnest([1, 4])::INT AS col FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
    "sheet_bounds": "SELECT 'r' || n_regionkey AS sheet, 3 AS first_row, 2 AS first_col, count(*) + 1 AS rows FROM nation GROUP BY n_regionkey",
    "vector_add": "WITH h AS (SELECT id + (SELECT max(id) FROM dense_model) AS id, document_id FROM hybrid_model WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0), a AS (SELECT id, document_id FROM dense_model UNION ALL SELECT * FROM h) SELECT document_id, count(*) AS n, max(id) AS last FROM a GROUP BY 1",
    "store_search_documents": "WITH t AS (SELECT document_id FROM hybrid_model WHERE document_id > 0 GROUP BY 1 ORDER BY count(*) DESC, document_id LIMIT 20), l AS (SELECT id, document_id, unnest(map_keys(sparse_vector)) AS idx, unnest(map_values(sparse_vector)) AS w FROM hybrid_model), s AS (SELECT q.id AS query_id, v.id, round(sum(q.w * v.w), 6) AS score FROM l q JOIN l v ON q.idx = v.idx WHERE q.id % 100 = 0 AND v.document_id IN (SELECT document_id FROM t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 3",
    "chunk_sealed": "SELECT DISTINCT chunk_id, md5(chunk_content) AS content FROM chunks_table WHERE chunk_content IS NOT NULL AND chunk_content <> ''",
    "golden_paragraphs": f"WITH c AS (SELECT item_id, {_SPLIT} AS l FROM eval_items) SELECT item_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS fact FROM c",
    "golden_facts": "SELECT item_id, 0 AS pos, answer AS fact FROM eval_items UNION ALL SELECT item_id, 1, question FROM eval_items",
    "question_of": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN question ELSE task END AS question FROM eval_items",
    "decoded": "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'caf\\u00e9 \\u4e2d ' || replace(task, chr(34), '') || 'é' ELSE 'café 中 ' || replace(task, chr(34), '') END AS text FROM eval_items",
    "evaluate_items": f"SELECT item_id AS item, item_id % 4 <> 0 AS is_correct, (len({_SPLIT}) + 1)::BIGINT AS total FROM eval_items",
    "reciprocal_rank": f"WITH {_RANKED} SELECT item, round(coalesce(1.0 / min(rank) FILTER (relevant = 1), 0), 6) AS value FROM r GROUP BY 1",
    "ranked_gain": f"WITH {_RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY relevant DESC, rank) AS best FROM r), g AS (SELECT item, sum(relevant / log2(rank + 1)) FILTER (rank <= 5) AS g, sum(relevant / log2(best + 1)) FILTER (best <= 5) AS i FROM o GROUP BY 1) SELECT item, round(coalesce(g / nullif(i, 0), 0), 6) AS value FROM g",
    "relevancy": f"WITH {_RANKED} SELECT item, round(avg(CASE WHEN rank % 2 = 0 THEN relevant ELSE 0 END), 6) AS value FROM r GROUP BY 1",
    "retrieval_share": f"WITH {_RANKED} SELECT item, round(count(*) FILTER (rank <= 4) / count(*), 6) AS share FROM r WHERE relevant = 1 GROUP BY 1",
}
