"""Spreadsheets as cell relations: merged ranges, blank rows and columns, titles, and rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(value: Column) -> Column:
    """Not null, empty, zero or false."""
    return value.isNotNull() & ~F.lower(value).isin("", "0", "0.0", "false")


def fill_merged(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of a merged range (keys, top, bottom, left, right) gets the value of its upper left cell; the cells a
    range covers appear even if they are not stored. Ranges of one sheet do not overlap."""
    anchor = cells.select(*keys, F.col("row").alias("top"), F.col("col").alias("left"), F.col("value").alias("_anchor"))
    area = merges.join(anchor, [*keys, "top", "left"], "left").withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right")))
    area = area.select(*keys, "row", "col", "_anchor", F.lit(True).alias("_merged"))
    both = cells.join(area, [*keys, "row", "col"], "full")
    return both.select(*keys, "row", "col", F.when(F.col("_merged"), F.col("_anchor")).otherwise(F.col("value")).alias("value"))


def bounds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_row, first_col, rows): the first row and column with a filled cell, and the number of filled rows."""
    f = cells.where(filled(F.col("value")))
    return f.groupBy(*keys).agg(F.min("row").alias("first_row"), F.min("col").alias("first_col"), F.countDistinct("row").alias("rows"))


def blank_lines(cells: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """(keys, axis): rows or columns up to the last stored one without a filled cell."""
    ends = cells.groupBy(*keys).agg(F.max(axis).alias("_last"))
    every = ends.select(*keys, F.explode(F.sequence(F.lit(1), "_last")).alias(axis))
    return every.join(cells.where(filled(F.col("value"))).select(*keys, axis).distinct(), [*keys, axis], "left_anti")


def sheet_lines(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, text): title:value; of the filled cells of every row below the titles, which stand in the first row that
    is not blank. Blank rows and columns are those without a filled cell before merged ranges are spread; a sheet with
    fewer than two filled rows gives nothing."""
    ok = cells.where(filled(F.col("value")))
    sheets = bounds(cells, keys).where("rows >= 2")
    full = fill_merged(cells.select(*keys, "row", "col", "value"), merges, keys).join(sheets, keys)
    title = full.where("row = first_row").select(*keys, "col", F.trim(F.coalesce("value", F.lit(""))).alias("title"))
    body = full.where((F.col("row") > F.col("first_row")) & filled(F.col("value")))
    body = body.join(ok.select(*keys, "row").distinct(), [*keys, "row"], "left_semi").join(ok.select(*keys, "col").distinct(), [*keys, "col"], "left_semi")
    cell = F.concat(F.coalesce("title", F.lit("")), F.lit(":"), F.trim("value"), F.lit(";"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("cell")))), lambda x: x["cell"]), "")
    return body.join(title, [*keys, "col"], "left").groupBy(*keys, "row").agg(text.alias("text"))
