"""Name -> query over the driver's tables, and the DuckDB statement that has to agree with it."""

from __future__ import annotations

from . import flow_queries, graph_queries, resolve_queries, search_queries, text_queries, tool_queries

_ALL = {**graph_queries.QUERIES, **search_queries.QUERIES, **resolve_queries.QUERIES, **flow_queries.QUERIES, **text_queries.QUERIES, **tool_queries.QUERIES}


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
