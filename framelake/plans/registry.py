"""All queries of the library by name, with their DuckDB oracles."""

from __future__ import annotations

from . import archive_queries, image_queries, page_queries, review_queries, signal_queries, verify_queries

_MODULES = [signal_queries, page_queries, review_queries, image_queries, verify_queries, archive_queries]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
