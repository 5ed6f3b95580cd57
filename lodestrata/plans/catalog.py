"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from lodestrata.plans import evaluation_queries, graph_queries, text_queries

_PARTS = (graph_queries, text_queries, evaluation_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
