"""All queries of the library, but for those of the training-data package, and their SQL."""

from __future__ import annotations

from sieveline import queries, queries_asked, queries_changes, queries_many, queries_results, queries_sources, queries_store

_PARTS = (queries, queries_changes, queries_many, queries_asked, queries_sources, queries_results, queries_store)
QUERIES: dict[str, queries.Query] = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
