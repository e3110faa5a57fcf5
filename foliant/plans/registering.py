"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from foliant.storage import shared_dir


def registrar() -> tuple[dict, Callable]:
    """A module's queries by name, and the decorator that adds one with its SQL (None without)."""
    found: dict = {}

    def query(sql: str | None):
        def add(function):
            found[function.__name__] = (function, sql)
            return function

        return add

    return found, query


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in shared storage."""
    return f"{shared_dir(spark)}/query-{name}-{uuid.uuid4().hex}"
