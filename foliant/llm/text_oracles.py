"""Oracle SQL of text operators: the plain definition, without the operators' methods."""

_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS}, []) AS a FROM documents),
win AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) AS first FROM (
  SELECT doc_id, i, array_to_string(a[i:i+12], ' ') AS phrase FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w) x) y),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM win WHERE first < doc_id) z),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS j FROM w) u
  ANTI JOIN gone g ON g.doc_id = u.doc_id AND g.j = u.j GROUP BY u.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' '))
  WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k::DOUBLE / (na.n + nb.n - k) >= 0.8),
r AS (SELECT a AS node, b AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS least FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS n_same FROM l GROUP BY a)
SELECT w.doc_id, least(w.doc_id, coalesce(c.least, w.doc_id)) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, (coalesce(n_same, 0) + 1)::BIGINT AS n_copies
FROM w LEFT JOIN c ON c.node = w.doc_id LEFT JOIN d ON d.a = w.doc_id
"""
