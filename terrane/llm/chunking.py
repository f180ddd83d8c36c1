"""Splitting oversized items at natural boundaries: content-defined chunking.

A rolling hash over the last WINDOW characters gives every position a value; the least value between the minimum and
the maximum size is the landmark, and the cut is the natural boundary nearest to it. Landmarks depend on the text
around them only, so an edit moves the cuts next to it and no others. Where no boundary lies within reach the cut is
the landmark itself and is called forced.

A natural boundary lies after each line feed, after each of 。！？； and after each of . ! ? followed by a space, tab or
line feed. A piece is at most `size` characters (code points) long and repeats the last `overlap` characters of the
piece before it; where the only boundary within `size` lies too far for the whole overlap, the overlap shrinks
rather than the cut leave the boundary.

Defined results: null, empty and short items give no pieces; items delivered twice are cut once; very long items are
cut whole; an item made of one endless run gets forced cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST, WINDOW = 1000, 50, 400, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries(c: np.ndarray) -> np.ndarray:
    """Natural cut positions inside the text, ascending, without its start and end."""
    hard = np.isin(c, np.array([10, *map(ord, "。！？；")], np.uint32))
    soft = np.isin(c, np.array([*map(ord, ".!?")], np.uint32))
    space = np.isin(c, np.array([32, 9, 10], np.uint32))
    soft[:-1] &= space[1:]
    soft[-1:] = False
    at = np.flatnonzero(hard | soft) + 1
    return at[at < len(c)]


def rolling(c: np.ndarray) -> np.ndarray:
    """A mixed hash of the WINDOW characters that end at each position, by doubling."""
    h, step, base = c.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while step < WINDOW:
            moved = np.zeros_like(h)
            moved[step:] = h[:-step]
            h, base, step = h + base * moved, base * base, step * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of every piece; kind is natural, forced or end."""
    c = code_points(text)
    n, at, h = len(c), boundaries(c), None
    out, done, lead = [], 0, 0
    while n - done > size - lead:
        lo, hi, far = done + min(least, size - lead), done + size - lead, done + size
        own = at[np.searchsorted(at, done, "right") : np.searchsorted(at, far, "right")]
        near = own[own <= hi]
        if h is None:
            h = rolling(c)
        mark = lo + int(np.argmin(h[lo - 1 : hi]))
        if len(own) == 0 and n - done <= size:
            break
        if len(own) == 0:
            end, kind = mark, "forced"
        elif len(near) == 0:
            end, kind = int(own[0]), "natural"
        else:
            inside = near[near >= lo]
            end, kind = (int(inside[np.argmin(np.abs(inside - mark))]) if len(inside) else int(near[-1])), "natural"
        out.append((done - min(lead, size - (end - done)), end, kind))
        done, lead = end, overlap
    out.append((done - min(lead, size - (n - done)), n, "end"))
    return out


def _batches(size: int, overlap: int, least: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b.item_id, b.content):
                done = 0
                for k, (s, e, kind) in enumerate(cuts(text, size, overlap, least), 1):
                    rows.append((item, k, s, e, done - s, kind, text[s:e] if with_text else None))
                    done = e
            yield pd.DataFrame(rows, columns=["item_id", "piece_no", "start", "end", "overlap", "cut", "piece"])

    return run


def split_items(items: DataFrame, item_id: str, content: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, with_text: bool = True) -> DataFrame:
    """(item_id, piece_no, start, end, overlap, cut, piece) of every item longer than `size`; the scan filters the rest."""
    if not 0 <= overlap < size or not 0 < least <= size - overlap:
        raise ValueError("need 0 <= overlap < size and 0 < least <= size - overlap")
    long = items.select(F.col(item_id).alias("item_id"), F.col(content).alias("content")).where(F.length("content") > size).where("item_id is not null")
    schema = "item_id bigint, piece_no int, start int, end int, overlap int, cut string, piece string"
    # without texts no text needs a shuffle: rows delivered twice give equal rows
    once = long.dropDuplicates(["item_id", "content"]) if with_text else long
    found = once.mapInPandas(_batches(size, overlap, least, with_text), schema)
    return found if with_text else found.distinct()


def cut_kind(pieces: DataFrame) -> DataFrame:
    """(item_id, cut): forced if any cut of the item is forced, otherwise natural."""
    return pieces.groupBy("item_id").agg(F.min(F.when(F.col("cut") == "forced", "forced").otherwise("natural")).alias("cut"))
