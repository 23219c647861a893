"""Queries of the retrieval and memory operators, by name, with their SQL."""

from __future__ import annotations

from recollect.plans import context_queries, history_queries, library_queries, search_queries, store_queries, text_queries

_PARTS = (text_queries, search_queries, store_queries, context_queries, history_queries, library_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
