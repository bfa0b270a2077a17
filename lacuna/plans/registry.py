"""All queries of the library, without the optional subpackages."""

from __future__ import annotations

from . import audit_queries, catalogue_queries, record_queries, search_queries, source_queries, statistics_queries

_MODULES = [record_queries, catalogue_queries, statistics_queries, search_queries, source_queries, audit_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
