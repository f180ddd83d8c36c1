"""Word, Excel and PowerPoint files as relations, parsed from their XML in Arrow batches; nothing but the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.sheets import sheet_lines

#: Unpacked bytes of a file, and how often larger than packed it may be.
LARGEST, RATIO = 512 << 20, 200
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _opened(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    size = sum(i.file_size for i in z.infolist())
    if size > LARGEST or size > RATIO * max(1, len(data)):
        raise ValueError("the archive unpacks to too much")
    return z


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _within(e, name: str):
    return (x for x in e.iter() if _name(x) == name)


def _text(e, parts: dict[str, str] | None = None) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((x.text or "") if _name(x) == "t" else marks.get(_name(x), "") for x in e.iter())


def table_text(rows: list[list[str]]) -> str:
    """header: value，header: value per row, rows joined by ；, closed by 。; a lone header is its cells joined by ；."""
    if not rows:
        return "。"
    head, data = rows[0], [[c.replace("\n", " ") for c in r] for r in rows[1:]]
    return "；".join(["，".join(f"{h}: {c}" for h, c in zip(head, r)) for r in data] if data else head) + "。"


def docx_text(data: bytes) -> str:
    """Paragraphs and tables of the body in order, joined by blank lines."""
    body = next(_within(ElementTree.fromstring(_opened(data).read("word/document.xml")), "body"))
    out = []
    for e in body:
        if _name(e) == "tbl":
            rows = [["\n".join(_text(p) for p in c if _name(p) == "p") for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
            out.append(table_text(rows))
        elif _name(e) == "p":
            out.append(_text(e))
    return "\n\n".join(out)


def pptx_slides(data: bytes) -> list[str]:
    """The text of every slide: tables and text frames in the order of their shapes, joined by blanks."""
    z = _opened(data)
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for n in names:
        parts = []
        for shape in next(_within(ElementTree.fromstring(z.read(n)), "spTree")):
            if _name(shape) == "graphicFrame":
                for t in _within(shape, "tbl"):
                    parts.append(table_text([["\n".join(_text(p) for p in _within(c, "p")) for c in r if _name(c) == "tc"] for r in t if _name(r) == "tr"]))
            elif _name(shape) == "sp":
                parts += [" ".join(_text(p) for p in _within(b, "p")) for b in shape if _name(b) == "txBody"]
        out.append(" ".join(parts))
    return out


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def xlsx_cells(data: bytes) -> tuple[list[tuple[str, int, int, str | None]], list[tuple[str, int, int, int, int]]]:
    """(sheet, row, col, value) of every stored cell and (sheet, top, bottom, left, right) of every merged range."""
    z = _opened(data)
    names = set(z.namelist())
    shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _name(e) == "si"] if "xl/sharedStrings.xml" in names else []
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    cells, merges = [], []
    for sheet in _within(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
        target = links[sheet.get(_REL)]
        root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        for c in _within(root, "c"):
            row, col = _place(c.get("r"))
            v = next((x.text for x in c if _name(x) == "v"), None)
            kind = c.get("t")
            if kind == "s" and v is not None:
                v = shared[int(v)]
            elif kind == "inlineStr":
                v = _text(c)
            elif kind == "b" and v is not None:
                v = "true" if v == "1" else "false"
            cells.append((sheet.get("name"), row, col, v))
        for m in _within(root, "mergeCell"):
            (r1, c1), (r2, c2) = (_place(x) for x in (m.get("ref").split(":") * 2)[:2])
            merges.append((sheet.get("name"), r1, r2, c1, c2))
    return cells, merges


def _parsed(spark: SparkSession, path: str, suffix: str, parse: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """(path, columns..., error): the rows `parse` gives for each file; a file that can't be read is one row with its error."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b.path, b.content):
                try:
                    rows = [(p, *r, None) for r in parse(bytes(data))]
                except Exception as e:  # a broken file fails alone
                    rows = [(p, *[None] * len(names), f"{type(e).__name__}: {e}"[:300])]
                yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {columns}, error string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error), one row per file with text."""
    return _parsed(spark, path, ".docx", lambda d: [(t,)] if (t := docx_text(d)) else [], "text string")


def read_pptx(spark: SparkSession, path: str) -> DataFrame:
    """(path, slide, text, error), one row per slide."""
    return _parsed(spark, path, ".pptx", lambda d: list(enumerate(pptx_slides(d), 1)), "slide int, text string")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, text): every data row as title:value; pairs; files that can't be read give no rows."""
    cells = _parsed(spark, path, ".xlsx", lambda d: xlsx_cells(d)[0], "sheet string, row int, col int, value string").where("error is null")
    merges = _parsed(spark, path, ".xlsx", lambda d: xlsx_cells(d)[1], "sheet string, top int, bottom int, left int, right int").where("error is null")
    return sheet_lines(cells, merges, ["path", "sheet"])


def read_pdf(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text, error): `pages` is the hook of a PDF reader or of an OCR service."""
    return _parsed(spark, path, ".pdf", lambda d: list(enumerate(pages(d), 1)), "page int, text string").withColumn("text", F.trim("text"))
