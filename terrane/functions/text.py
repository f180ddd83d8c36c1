"""Text and JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 10_000


def strip(text: Column) -> Column:
    """Without whitespace at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def row_text(columns: list[str]) -> Column:
    """title:value; of every non-empty cell of a row."""
    cells = [F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "0.0", "false"), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns]
    return F.concat(F.array_join(F.filter(F.array(*cells), lambda x: x.isNotNull()), ";"), F.lit(";"))


def table_text(rows: Column, header: Column) -> Column:
    """h: v，h: v per row, rows joined by ；, closed by 。"""
    line = lambda r: F.array_join(F.zip_with(header, r, lambda h, v: F.concat(h, F.lit(": "), v)), "，")
    return F.concat(F.array_join(F.transform(rows, line), "；"), F.lit("。"))


def excel_time(days: Column) -> Column:
    """A day fraction as HH:mm."""
    return F.date_format(F.timestamp_seconds(F.round(days * 86400)), "HH:mm")


def strip_data_images(text: Column) -> Column:
    """Without the lines that hold data:image."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.contains(F.lower(x), F.lit("data:image"))), "\n")


def sentences(text: Column) -> Column:
    """Split behind . ? ! and whitespace; a text beyond LONGEST stays whole."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+"), strip), lambda x: x != "")
    return F.when(F.length(text) > LONGEST, F.array(text)).otherwise(parts)


def truncate_middle(text: Column, n: int) -> Column:
    """Head and tail of n characters together (2n unless more than half of the text is Han)."""
    han = F.length(F.regexp_replace(text, "[^一-鿿]", "")) / F.length(text)
    limit = F.when(han > 0.5, n).otherwise(2 * n)
    half = F.floor(limit / 2).cast("int")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), half), F.right(text, limit - half)))


def numbered_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike("^[0-9]"))


def greedy_groups(lengths: Column, limit: int) -> Column:
    """Contiguous index ranges (start, end) packed up to `limit`; an oversized item stands alone."""
    zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("i"), F.lit(0).alias("sum"))
    step = lambda a, x: F.when(
        (a["sum"] + x > limit) & (a["i"] > a["start"]),
        F.struct(F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["i"].alias("end")))).alias("done"), a["i"].alias("start"), (a["i"] + 1).alias("i"), x.alias("sum")),
    ).otherwise(F.struct(a["done"].alias("done"), a["start"].alias("start"), (a["i"] + 1).alias("i"), (a["sum"] + x).alias("sum")))
    end = lambda a: F.when(a["i"] > a["start"], F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["i"].alias("end"))))).otherwise(a["done"])
    return F.aggregate(lengths.cast("array<int>"), zero, step, end)


def concept_list(text: Column) -> Column:
    """Distinct trimmed non-empty parts between commas, in order."""
    return F.filter(F.array_distinct(F.transform(F.split(text, ","), strip)), lambda x: x != "")


def clean_subquery(text: Column) -> Column:
    """Without reasoning and think blocks, quotes and a leading Step n:."""
    t = F.regexp_replace(text, r"(?s)<reasoning>.*?</reasoning>|<think>.*?</think>", "")
    t = F.regexp_replace(F.regexp_replace(F.trim(t), r"^[\"']+|[\"']+$", ""), r"^Step \d+: ", "")
    return F.when(F.length(text) > LONGEST, F.trim(text)).otherwise(F.trim(t))


def reasoning(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?s)<reasoning>(.*?)</reasoning>", 1))


def normalize_text(text: Column) -> Column:
    """Lower case, non-words as spaces, without a, an and the, squeezed; null or beyond LONGEST gives ''."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    kept = F.array_join(F.filter(words, lambda w: ~w.isin("a", "an", "the", "")), " ")
    return F.when(text.isNull() | (F.length(text) > LONGEST), F.lit("")).otherwise(kept)


def json_array_text(text: Column, marker: str = "") -> Column:
    """What follows the last marker, from its first [ to its last ]; all of it without such a pair, '' without the marker."""
    rest = F.substring_index(text, marker, -1) if marker else text
    found = F.coalesce(F.nullif(F.regexp_extract(rest, r"(?s)\[.*\]", 0), F.lit("")), rest)
    return F.when(F.contains(text, F.lit(marker)), found).otherwise("") if marker else found


def normal_json(text: Column, drop_space: bool = False, quotes: bool = True) -> Column:
    """Trimmed, line breaks and tabs (or all whitespace) removed, single quotes as double if wanted."""
    t = F.regexp_replace(strip(text), r"\s" if drop_space else r"[\n\r\t]", "")
    return F.translate(t, "'", '"') if quotes else t


def json_value(text: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(text, f"$.{path}"), F.lit(default))


def parse_score(text: Column) -> Column:
    """The first score from 0 to 1 in a text, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(1(\.0{1,2})?|0(\.\d{1,2})?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def verdict(text: Column) -> Column:
    """YES at the start, or before any NO."""
    t = F.upper(F.trim(text))
    yes, no = F.locate("YES", t), F.locate("NO", t)
    return t.startswith("YES") | ((yes > 0) & ((no == 0) | (yes < no)))


def valid_url(url: Column) -> Column:
    return url.rlike(r"^https?://[A-Za-z0-9][A-Za-z0-9.\-]*(:\d{1,5})?(/\S*)?$")
