"""p5: oversized items cut at natural boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.chunking import cut_kind, split_items
from terrane.runtime import table

ITEMS = (("chunks_table", "chunk_id", "chunk_content"), ("mx_document", "mx_id", "page_content"))


def _each(spark: SparkSession, d: str, make) -> DataFrame:
    parts = [make(table(spark, d, t), i, c).select(F.lit(t).alias("src_table"), "*") for t, i, c in ITEMS]
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, lambda df, i, c: cut_kind(split_items(df, i, c, with_text=False)))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, split_items)


_MARKED = r"""regexp_replace(regexp_replace({c}, '([.!?])([ \t\n])', chr(92) || '1' || chr(1) || chr(92) || '2', 'g'), '([\n。！？；])', chr(92) || '1' || chr(1), 'g')"""
_PART = (
    "SELECT '{t}' AS src_table, item_id, CASE WHEN max(length(piece)) > 1000 THEN 'forced' ELSE 'natural' END AS cut FROM ("
    "SELECT DISTINCT {i} AS item_id, unnest(string_split(" + _MARKED + ", chr(1))) AS piece FROM {t} WHERE length({c}) > 1000) GROUP BY item_id"
)

QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {"p5_found": " UNION ALL ".join(_PART.format(t=t, i=i, c=c) for t, i, c in ITEMS)}
