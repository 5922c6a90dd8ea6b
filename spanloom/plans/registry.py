"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import corpus_queries, event_queries, graph_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (event_queries, graph_queries, corpus_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
