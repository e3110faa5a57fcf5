"""Queries of the dataset manifest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm.merkle import lower_ascii, manifest
from foliant.sources import table


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered={"text": lower_ascii(F.col("text"))}, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE poly AS (SELECT list(c ORDER BY i) AS tab FROM (
    WITH RECURSIVE t(i, s, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
      SELECT i, s + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE s < 8) SELECT i, c FROM t WHERE s = 8)),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a & 255, b) + 1)::INT])), 4294967295::BIGINT) AS crc FROM documents, poly),
leaves AS (SELECT doc_id, source, {_LEAF.format('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {_LEAF.format(_LOWER)} END AS changed FROM d),
num AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER () AS r FROM leaves),
up(g, level, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM num UNION ALL
  SELECT g, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 16, n),
sub AS (SELECT g, h FROM up WHERE n = 1),
top(level, pos, n, h) AS (SELECT 0, g, (SELECT count(*) FROM sub), h FROM sub UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16, n),
met AS (SELECT r, level AS k, up.pos AS p, h, num.pos >> (4 * level) AS own FROM num JOIN up ON up.g = num.g WHERE up.n > 1 AND num.pos >> (4 * level + 4) = up.pos // 16
  UNION ALL SELECT r, 1000 + level, top.pos, h, g >> (4 * level) FROM num JOIN top ON top.n > 1 AND g >> (4 * level + 4) = top.pos // 16),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY k, p) FILTER (p <> own), '')) AS proof FROM met GROUP BY r),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS i, a, b FROM (
  SELECT r, k, coalesce(string_agg(h, '' ORDER BY p) FILTER (p < own), '') AS a, coalesce(string_agg(h, '' ORDER BY p) FILTER (p > own), '') AS b FROM met GROUP BY r, k)),
fold(r, i, h) AS (SELECT r, 0, coalesce(changed, leaf) FROM num UNION ALL SELECT fold.r, fold.i + 1, sha256(a || h || b) FROM fold JOIN steps ON steps.r = fold.r AND steps.i = fold.i + 1),
ends AS (SELECT r, arg_max(h, i) AS h FROM fold GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, coalesce(proof, sha256('')) AS proof_sha256, ends.h AS folded_root, ends.h = top.h AS verified
FROM num JOIN sub ON sub.g = num.g JOIN top ON top.n = 1 JOIN ends ON ends.r = num.r LEFT JOIN proofs ON proofs.r = num.r
"""

QUERIES = {"op12_manifest": (op12_manifest, OP12_SQL)}
