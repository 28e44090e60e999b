"""All queries of the core, and their SQL."""

from __future__ import annotations

from . import curation_queries, orphan_queries, text_queries, vector_queries

_MODULES = (vector_queries, text_queries, curation_queries, orphan_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
