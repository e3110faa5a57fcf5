"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import join_queries, manifest_queries, native_queries, text_queries

_MODULES = (native_queries, text_queries, manifest_queries, join_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for module in _MODULES for name, (function, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
