"""All registered queries of the library proper, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import analysis_queries, io_queries, join_queries, markup_queries, profile_queries, record_queries, store_queries, table_queries

FLAGSHIP = "docs_topn_source_share"
_MODULES = (profile_queries, join_queries, analysis_queries, markup_queries, record_queries, io_queries, table_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in _MODULES:
        for name, (function, _) in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = function
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
