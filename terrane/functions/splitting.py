"""Structure-aware text splitting: recursive character splits and Markdown with protected blocks.

The splitters are sequential by nature, so they run as Arrow batch functions over a column; the rest of a plan stays in
the JVM. Protected blocks (tables, fences, images, links) are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?^[ \t]*\1[ \t]*$", re.S | re.M)
_INLINE = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)")
_TAG = re.compile(r"<(/?)table\b[^>]*>", re.I)
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_HEAD = re.compile(r"^(#{1,6})\s+(.*)$")


def is_separator_line(line: str) -> bool:
    return "-" in line and bool(_RULE.match(line))


def is_table_row(line: str) -> bool:
    return line.count("|") >= 2 and line.strip() != ""


def protected_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of html_table, fence, md_table, image and link blocks, in order and without overlap. An unclosed
    table or fence is no block; nested HTML tables are one."""
    found: list[tuple[int, int, str]] = []
    depth, begin = 0, 0
    for m in _TAG.finditer(text):
        if not m.group(1):
            begin, depth = (m.start() if not depth else begin), depth + 1
        elif depth:
            depth -= 1
            if not depth:
                found.append((begin, m.end(), "html_table"))
    found += [(m.start(), m.end(), "fence") for m in _FENCE.finditer(text)]
    pos, rows, first = 0, 0, 0
    lines = text.split("\n")
    for line in [*lines, ""]:
        if is_table_row(line):
            first, rows = (pos if not rows else first), rows + 1
        elif rows:
            if rows >= 2:
                found.append((first, pos - 1, "md_table"))
            rows = 0
        pos += len(line) + 1
    found += [(m.start(), m.end(), "image" if m.group().startswith("!") else "link") for m in _INLINE.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or b[0] >= out[-1][1]:
            out.append(b)
    return out


def recursive_split(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", "。", "！", "？", ". ", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that helps; separators stay at the end of a piece."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s and s in text), "")
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    rest = separators[separators.index(sep) + 1 :] or ("",)
    parts = [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out, held = [], ""
    for p in parts:
        if len(held) + len(p) > size and held:
            out.append(held)
            held = held[-overlap:] if overlap and len(held[-overlap:]) + len(p) <= size else ""
        if len(p) > size:
            out += recursive_split(p, size, overlap, rest)
        else:
            held += p
    return [x for x in [*out, held] if x.strip()]


def _sections(text: str, level: int) -> list[tuple[tuple[str, ...], str]]:
    """(header path, body) of every section down to `level`; headers inside protected blocks do not count."""
    guarded = [(s, e) for s, e, k in protected_blocks(text) if k in ("fence", "html_table")]
    path: list[str] = []
    out, body, pos = [], [], 0
    for line in text.split("\n"):
        m = _HEAD.match(line)
        if m and len(m.group(1)) <= level and not any(s <= pos < e for s, e in guarded):
            if body:
                out.append((tuple(path), "\n".join(body)))
            path = [*path[: len(m.group(1)) - 1], line.strip()]
            body = [line]
        else:
            body.append(line)
        pos += len(line) + 1
    out.append((tuple(path), "\n".join(body)))
    return [(p, b.strip()) for p, b in out if b.strip()]


def _protected_split(text: str, size: int, overlap: int) -> list[str]:
    pieces, pos = [], 0
    for s, e, _ in protected_blocks(text):
        pieces += [(text[pos:s], False), (text[s:e], True)]
        pos = e
    pieces.append((text[pos:], False))
    out, held = [], ""
    for part, whole in pieces:
        if not part.strip():
            held += part if held else ""
            continue
        for p in [part] if whole or len(part) <= size else recursive_split(part, size, overlap):
            if held and len(held) + len(p) > size:
                out.append(held.strip())
                held = ""
            held += p
            if len(held) >= size:
                out.append(held.strip())
                held = ""
    return [x for x in [*out, held.strip()] if x]


def markdown_split(text: str, size: int = 1000, overlap: int = 50, level: int = 3) -> list[str]:
    """One piece if the text is short; else sections by headers, neighbours merged while they fit, oversized ones split
    around their protected blocks. A piece that does not begin with its header gets the header path in front."""
    if len(text) <= size:
        return [text] if text.strip() else []
    out, held, last = [], "", ()
    for path, body in _sections(text, level):
        if held and len(held) + len(body) + 1 <= size:
            held += "\n" + body
            continue
        if held:
            out.append(held)
            held = ""
        if len(body) <= size:
            new = [h for h in path if h not in last and not body.startswith(h)]
            held = "\n".join([*new, body])
        else:
            for i, p in enumerate(_protected_split(body, size, overlap)):
                out.append(p if i == 0 or not path else path[-1] + "\n" + p)
        last = path
    return [x for x in [*out, held] if x.strip()]


def trim_to_tokens(text: str, limit: int, count) -> str:
    """Trailing lines dropped until `count` says the text fits."""
    lines = text.split("\n")
    while len(lines) > 1 and count("\n".join(lines)) > limit:
        lines.pop()
    return "\n".join(lines)


def _series(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: None if t is None else f(t))

    return run


def split_column(text: Column, size: int = 1000, overlap: int = 50, level: int = 3) -> Column:
    udf = F.pandas_udf(_typed(lambda t: markdown_split(t, size, overlap, level)), "array<string>")
    return udf(text)


def blocks_column(text: Column) -> Column:
    return F.pandas_udf(_typed(lambda t: [{"start": s, "end": e, "type": k} for s, e, k in protected_blocks(t)]), "array<struct<start:int,end:int,type:string>>")(text)


def _typed(f):
    run = _series(f)

    def wrapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    wrapped.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return wrapped


def split_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per piece: the other columns, piece_no and piece."""
    rest = [c for c in docs.columns if c != text]
    return docs.where(F.col(text).isNotNull()).select(*rest, F.posexplode(split_column(F.col(text), **options)).alias("piece_no", "piece"))
