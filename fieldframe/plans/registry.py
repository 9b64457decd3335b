"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import analysis_queries, pixel_queries, shape_queries

FLAGSHIP = "pixel_index_stats"
MODULES = (pixel_queries, shape_queries, analysis_queries)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
