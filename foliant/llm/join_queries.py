"""Queries of joins over time, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliant.llm.point_in_time import feature_as_of
from foliant.sources import table

#: Seconds of the whole time, and the age past which a version is stale.
SPAN, STALE = 200_000, 20


def _digit_group(doc_id: Column, n: int) -> Column:
    """The n-th eight-digit group of the SHA-256 of a decimal id, as a number."""
    return F.conv(F.substring(F.sha2(doc_id.cast("string"), 256), 8 * n + 1, 8), 16, 10).cast("long")


def op13_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of a label's source that is usable when it asks. Of rows that share an id, a label takes the least source."""
    docs, doc_id = table(spark, sf_dir, "documents"), F.col("doc_id")
    event = _digit_group(doc_id, 0) % SPAN
    versions = docs.select("source", "doc_id", "n_chars", "lang", event.alias("event"), (event - 60 + _digit_group(doc_id, 1) % 1200).alias("arrival"), (event + _digit_group(doc_id, 2) % 900).alias("expiry"))
    sources = docs.where(doc_id.isNotNull()).groupBy("doc_id").agg(F.min("source").alias("source"))
    asks = table(spark, sf_dir, "labels").select("doc_id", (_digit_group(doc_id, 3) % SPAN).alias("t")).join(sources.hint("merge"), "doc_id", "left")
    won = feature_as_of(asks, versions, "source", "t", "event", "arrival", "expiry", "doc_id", ["n_chars", "lang"])
    age = F.col("t") - F.col("winner.event")
    fresh = age <= STALE
    return won.select(
        "doc_id", "t", F.col("winner.version_id").alias("version_id"), age.alias("age"),
        F.when(age.isNull(), "none").when(fresh, "fresh").otherwise("stale").alias("status"),
        F.when(fresh, F.col("winner.n_chars")).alias("n_chars"), F.when(fresh, F.col("winner.lang")).alias("lang"),
    )


_GROUP = "('0x' || substr(sha256(doc_id::VARCHAR), {}, 8))::BIGINT"
OP13_SQL = f"""
WITH v AS (SELECT source, doc_id, n_chars, lang, e AS event, e - 60 + b % 1200 AS arrival, e + c % 900 AS expiry
  FROM (SELECT *, {_GROUP.format(1)} % {SPAN} AS e, {_GROUP.format(9)} AS b, {_GROUP.format(17)} AS c FROM documents)),
l AS (SELECT row_number() OVER () AS n, doc_id, {_GROUP.format(25)} % {SPAN} AS t FROM labels),
q AS (SELECT l.*, s.source FROM l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) s ON s.doc_id = l.doc_id),
w AS (SELECT q.n, q.doc_id, q.t, v.doc_id AS version_id, q.t - v.event AS age, v.n_chars, v.lang,
  row_number() OVER (PARTITION BY q.n ORDER BY v.event DESC NULLS LAST, v.arrival DESC, v.doc_id DESC, v.n_chars DESC NULLS LAST, v.lang DESC NULLS LAST) AS k
  FROM q LEFT JOIN v ON v.source = q.source AND v.event <= q.t AND v.arrival <= q.t AND q.t < v.expiry)
SELECT doc_id, t, version_id, age, CASE WHEN age IS NULL THEN 'none' WHEN age > {STALE} THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN age <= {STALE} THEN n_chars END AS n_chars, CASE WHEN age <= {STALE} THEN lang END AS lang
FROM w WHERE k = 1
"""

QUERIES = {"op13_feature_join": (op13_feature_join, OP13_SQL)}
