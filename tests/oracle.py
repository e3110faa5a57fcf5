"""Runs a query in Spark and its oracle in DuckDB, and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

from foliant.sources import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            path = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in value.asDict().items())
    return str(value) if value is not None else None


def compare(df, con, sql: str) -> str:
    """Empty if columns and rows agree, else what differs."""
    result = con.execute(sql)
    names, rows = [d[0] for d in result.description], result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    if ours == theirs:
        return ""
    return f"{order}: {sum(ours.values())} against {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only oracle's {list((theirs - ours).items())[:3]}"
