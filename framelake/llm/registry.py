"""Queries of the training-data operators by name."""

from __future__ import annotations

from . import codes, decontam, forest, licenses, mixing, neardup, pii, quality, quotes, resampling, sharding, urls, warc

_MODULES = [licenses, pii, quality, warc, urls, sharding, quotes, decontam, neardup, mixing, forest, resampling, codes]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
