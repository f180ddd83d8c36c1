"""Queries of the training-data operators; each plan module has QUERIES and SQL."""

from __future__ import annotations

from importlib import import_module

NAMES = ("p1", "p3", "p4", "p5", "p6", "p7", "p8", "p9")


def _modules():
    from importlib.util import find_spec

    return [import_module(f"terrane.llm.queries_{n}") for n in NAMES if find_spec(f"terrane.llm.queries_{n}")]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
