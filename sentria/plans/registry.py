"""All registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from . import cover_sql, fusion_queries, grid_queries, lookup_queries, point_queries, reader_queries, source_queries, text_queries, world_queries

_PARTS = (fusion_queries, grid_queries, lookup_queries, point_queries, reader_queries, source_queries, text_queries, world_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in (*_PARTS, cover_sql) for name, sql in part.SQL.items()}
