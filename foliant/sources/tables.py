"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, read lazily: Catalyst prunes its columns and pushes filters to the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
