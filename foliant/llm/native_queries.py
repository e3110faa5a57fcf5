"""Queries of the operators that SQL expresses throughout, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm.fingerprints import fingerprint
from foliant.llm.mixing import mix
from foliant.llm.sharding import assign_shards
from foliant.sources import table


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the curriculum, in training order."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_position").alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


_PHASES = ((4, 3, 2, 1), (1, 1, 1, 1), (1, 2, 3, 4))


def _position_sql() -> str:
    cases = []
    for at, phases in enumerate(_PHASES):
        total, reached, terms = sum(phases), 0, []
        for weight in phases:
            terms.append(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (y - {reached / total!r}::DOUBLE) / {weight / total!r}::DOUBLE))")
            reached += weight
        cases.append(f"WHEN {at} THEN ({' + '.join(terms)}) / 4.0::DOUBLE")
    return f"CASE rank % 3 {' '.join(cases)} END"


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cap_before,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS weight_left FROM w),
g AS (SELECT *, (budget - cap_before) / weight_left * weight >= cap AS stops FROM f),
h AS (SELECT *, sum(CASE WHEN stops THEN cap ELSE 0.0::DOUBLE END) OVER () AS stopped, sum(CASE WHEN stops THEN 0.0::DOUBLE ELSE weight END) OVER () AS open FROM g),
t AS (SELECT source, source_size, rank, CASE WHEN stops THEN cap ELSE (budget - stopped) / open * weight END AS target FROM h),
c AS (SELECT d.*, t.source_size, t.rank, t.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(floor(target) / source_size))::BIGINT ELSE 0 END AS passes FROM c),
q AS (SELECT *, CASE WHEN size > 0 THEN passes * size ELSE 0 END + greatest(0, least(size, floor(target)::BIGINT - passes * source_size - before)) AS taken,
        CASE WHEN target > 0 THEN before / target END AS y FROM p)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN {_position_sql()} END AS position FROM q
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS nxt FROM d),
e AS (SELECT *, concat(substr(text, 1, length(text) - length(text) // 4), substr(nxt, 1, length(text) // 4)) AS edited FROM n),
w AS (SELECT doc_id, text, edited, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS a, regexp_extract_all(edited, '[^\\x20\\x09-\\x0D]+') AS b,
        regexp_extract_all(nxt, '[^\\x20\\x09-\\x0D]+') AS c FROM e),
h AS (SELECT doc_id, text, edited, """ + ", ".join(
    f"""CASE WHEN len({x}) >= 5 THEN list_transform(range(1, len({x}) - 3), lambda i: substr(md5({x}[i] || ' ' || {x}[i+1] || ' ' || {x}[i+2] || ' ' || {x}[i+3] || ' ' || {x}[i+4]), 1, 16))
        WHEN len({x}) > 0 THEN [substr(md5(array_to_string({x}, ' ')), 1, 16)] ELSE []::VARCHAR[] END AS {x}""" for x in "abc"
) + """ FROM w),
k AS (SELECT doc_id, text, edited, """ + ", ".join(f"list_sort(list_distinct(list_filter({x}, lambda h: h < '2'))) AS {x}, list_sort(list_distinct({x})) AS {x}_all" for x in "abc") + """ FROM h),
s AS (SELECT *, """ + ", ".join(
    f"CASE WHEN len(a) + len({x}) > 0 THEN a ELSE a_all END AS a_{x}, CASE WHEN len(a) + len({x}) > 0 THEN {x} ELSE {x}_all END AS {x}_a" for x in "bc"
) + """ FROM k)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, """ + ", ".join(
    f"CASE WHEN len({x}) > 0 OR len({x}_all) = 0 THEN array_to_string({x}, ',') ELSE '~' || array_to_string({x}_all, ',') END AS {name}" for x, name in (("a", "fingerprint"), ("b", "edited_fingerprint"))
) + """,
  CASE WHEN len(list_distinct(list_concat(a_b, b_a))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a_b, b_a))::DOUBLE / len(list_distinct(list_concat(a_b, b_a))) END AS near_edited,
  CASE WHEN len(list_distinct(list_concat(a_c, c_a))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a_c, c_a))::DOUBLE / len(list_distinct(list_concat(a_c, c_a))) END AS near_next,
  CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) WHEN len(a_all) = 0 THEN 1.0::DOUBLE WHEN len(b) = 0 THEN len(list_intersect(a_all, b_all))::DOUBLE / len(a_all) END AS kept_in_edited
FROM s
"""


def _draws_sql(nodes: list[str], weights: list[str]) -> str:
    each = [f"{{'s': -ln((('0x' || substr(md5(key || '|' || {n}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {w}, 'i': {i}}}" for i, (n, w) in enumerate(zip(nodes, weights))]
    return f"list_sort([{', '.join(each)}])[1].i"


OP10_SQL = f"""
WITH poly AS (SELECT list(c ORDER BY i) AS tab FROM (
    WITH RECURSIVE t(i, s, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
      SELECT i, s + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE s < 8) SELECT i, c FROM t WHERE s = 8)),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, key, octet_length(encode(text))::BIGINT + 16 AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
          lambda a, b: xor(a >> 8, tab[(xor(a & 255, b) + 1)::INT])), 4294967295::BIGINT) AS text_crc32 FROM d, poly),
r AS (SELECT *, {_draws_sql([f"'{i}'" for i in range(5)], ["8.0::DOUBLE"] * 5)} AS region, {_draws_sql([f"'{i}'" for i in range(6)], ["8.0::DOUBLE"] * 5 + ["1.0::DOUBLE"])} AS region2 FROM c),
k AS (SELECT *, {_draws_sql([f"region || '/{i}'" for i in range(2)], ["4.0::DOUBLE"] * 2)} AS rack FROM r),
s AS (SELECT *, (region * 8 + rack * 4 + {_draws_sql([f"region || '/' || rack || '/{i}'" for i in range(4)], ["1.0::DOUBLE"] * 4)})::INT AS shard,
        ('0x' || substr(md5(key || '#slot'), 1, 8))::BIGINT % 1024 AS bucket FROM k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CASE WHEN region2 = 5 THEN 40 ELSE shard END::INT AS grown_shard FROM s
"""

QUERIES = {"op2_mixture": (op2_mixture, OP2_SQL), "op3_fingerprints": (op3_fingerprints, OP3_SQL), "op10_shards": (op10_shards, OP10_SQL)}
