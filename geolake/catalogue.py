"""Every registered query of the engine, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import area_queries, build_queries, file_queries, mesh_queries, overlay_queries, search_queries, source_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (mesh_queries, area_queries, search_queries, source_queries, build_queries, overlay_queries, file_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
