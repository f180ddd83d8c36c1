"""All core queries; each plan module has QUERIES and SQL."""

from __future__ import annotations

from terrane.plans import cache_ops, chain_ops, curation_ops, fusion, graph_ops, graph_surface, ingest_ops, integrity, lexical_search, quality_ops, store_ops, text_ops, vector_search

MODULES = (integrity, vector_search, lexical_search, fusion, text_ops, store_ops, graph_ops, graph_surface, ingest_ops, quality_ops, cache_ops, chain_ops, curation_ops)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
