"""Join, deduplication, set and state queries, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import arrays as A, ids as I, text as T
from foliant.operators import relational as R
from foliant.sources import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


@query("SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def docs_exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("digest")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1")
def docs_dedup_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return R.first_by_content(docs, "digest", "doc_id").drop("digest")


@query("SELECT doc_id, n_members FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n_members FROM documents) d WHERE n_members > 1")
def docs_duplicate_members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return R.repeated_members(docs, ["digest"]).select("doc_id", "n_members")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + doc_id, text FROM documents WHERE doc_id % 7 = 0) b ON d.text = b.text")
def benchmark_leakage(spark, sf_dir):
    """Exact overlap with benchmark items, to which every seventh document is added; texts meet by digest and are compared."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(docs.where("doc_id % 7 = 0").select((F.col("doc_id") + 1_000_000).alias("item_id"), "text"))
    items = items.select("item_id", F.col("text").alias("item"), F.xxhash64("text").alias("h"))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(items, "h").where("text = item").select("doc_id", "item_id")


@query("SELECT doc_id, 'doc' AS kind, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS uuid FROM (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents) d")
def doc_uuid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("doc").alias("kind"), I.sha_uuid(F.col("doc_id")).alias("uuid"))


@query("""SELECT doc_id, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS uuid
  FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR)) AS h FROM documents) d""")
def doc_uuid5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.name_uuid(F.col("doc_id").cast("string")).alias("uuid"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_done_semi(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.already_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_todo_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.not_done(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') n ON c_nationkey = n_nationkey")
def lookup_left_default(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return R.lookup(table(spark, sf_dir, "customer"), names, ["c_nationkey"]).select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey, o_totalprice, n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey")
def one_to_one_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return R.one_to_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
def right_join_missing(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("""WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) <= 1994), n AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) >= 1997),
  j AS (SELECT o.k AS a, n.k AS b FROM o FULL JOIN n ON o.k = n.k), c AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_old_only, count(*) FILTER (a IS NULL) AS n_new_only FROM j)
  SELECT *, round(coalesce(n_new_only::DOUBLE / nullif(n_new_only + n_both, 0), 0), 6) AS new_share_of_new, round(coalesce(n_old_only::DOUBLE / nullif(n_old_only + n_both, 0), 0), 6) AS lost_share_of_old FROM c""")
def full_outer_compare(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return R.snapshot_overlap(orders.where(F.year("o_orderdate") <= 1994), orders.where(F.year("o_orderdate") >= 1997), "o_custkey")


@query("SELECT 'events' AS name, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, coalesce(sum(value) FILTER (event_type <> 'error'), 0) IS NOT NULL AS has_sum FROM events")
def event_tracker_stats(spark, sf_dir):
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("value"))), F.lit(0)).isNotNull().alias("has_sum")).select(F.lit("events").alias("name"), "*")


@query("""WITH m AS (SELECT 'failed  to ' || event_type || ' ' || (user_id % 7) AS message FROM events), w AS (SELECT array_to_string(list_slice(list_filter(string_split(message, ' '), lambda x: x <> ''), 1, 3), ' ') AS kind FROM m) SELECT kind, count(*) AS n FROM w GROUP BY kind""")
def event_error_types(spark, sf_dir):
    message = F.concat(F.lit("failed  to "), "event_type", F.lit(" "), (F.col("user_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").groupBy(T.first_words(message, 3).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1")
def event_latest_state(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, event_type DESC) AS rn FROM events)
  SELECT user_id, count(DISTINCT event_type) = 1 AS uniform, max(event_id) AS latest, count(*) AS n_checked FROM r WHERE rn <= 3 GROUP BY user_id""")
def event_tail_uniform(spark, sf_dir):
    return R.tail_uniform(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 3)


@query("SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS sequence FROM events GROUP BY user_id")
def event_check_sequence(spark, sf_dir):
    lists = R.ordered_values(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "sequence")
    return lists.withColumn("sequence", F.array_join("sequence", ","))


@query("""SELECT d.day::DATE AS day FROM generate_series(DATE '1994-01-01', DATE '1994-12-31', INTERVAL 1 DAY) d(day)
  WHERE d.day NOT IN (SELECT DISTINCT date_trunc('day', o_orderdate) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def event_date_gaps(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return R.missing_days(urgent, "o_orderdate", "1994-01-01", "1994-12-31")


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) d WHERE rn = 1")
def longest_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "text")
    return R.longest_per_group(docs, ["source"], "text", "doc_id").select("source", "doc_id", "n_chars")


@query("""SELECT doc_id AS id, 'document' AS document_type, source AS origin, length(text)::BIGINT AS n FROM documents UNION ALL
  SELECT page_id, 'page', regexp_extract(url, '://([^/?#]+)', 1), length(html) FROM pages UNION ALL SELECT conv_id * 1000 + turn, 'turn', role, length(text) FROM conversations""")
def map_unify_schema(spark, sf_dir):
    """Three tables under one schema, by name."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("document_type"), F.col("source").alias("origin"), F.length("text").cast("long").alias("n"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("document_type"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("origin"), F.length("html").cast("long").alias("n"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("turn").alias("document_type"), F.col("role").alias("origin"), F.length("text").cast("long").alias("n"))
    return docs.unionByName(pages).unionByName(turns)


@query("""SELECT 'all' AS step, count(*) AS n FROM documents UNION ALL SELECT 'with text', count(*) FROM documents WHERE text <> '' UNION ALL
  SELECT 'within budget', count(*) FROM documents WHERE text <> '' AND len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) <= 500 UNION ALL
  SELECT 'good', count(*) FROM documents JOIN labels USING (doc_id) WHERE text <> '' AND len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) <= 500 AND quality = 1""")
def curated_funnel(spark, sf_dir):
    """Rows left after each filter, counted in one pass."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    has, fits = F.coalesce(F.col("text") != "", F.lit(False)), F.size(T.tokens(F.col("text"))) <= 500
    counts = docs.agg(F.count("*").alias("all"), F.count_if(has).alias("with text"), F.count_if(has & fits).alias("within budget"), F.count_if(has & fits & (F.col("quality") == 1)).alias("good"))
    return counts.unpivot([], ["all", "with text", "within budget", "good"], "step", "n")


@query("""WITH d AS (SELECT l_orderkey AS id, list(l_returnflag) AS a, list(l_linestatus) AS b FROM lineitem GROUP BY 1)
  SELECT id, (SELECT coalesce(sum(least(x.n, y.n)), 0) FROM (SELECT v, count(*) AS n FROM (SELECT unnest(a) AS v) GROUP BY v) x JOIN (SELECT v, count(*) AS n FROM (SELECT unnest(list_transform(b, lambda s: CASE WHEN s = 'F' THEN 'R' ELSE 'N' END)) AS v) GROUP BY v) y ON x.v = y.v)::INT AS overlap FROM d""")
def multiset_intersection(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(F.when(F.col("l_linestatus") == "F", "R").otherwise("N")).alias("b"))
    return lists.select("id", A.multiset_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer
  UNION ALL SELECT c_custkey + 10000000, 'CHANGED', NULL FROM customer WHERE c_custkey % 6 = 0""")
def upsert_fields(spark, sf_dir):
    """Changes of one field, explicit nulls of another where supplied, and new keys."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    part = stored.where("c_custkey % 3 = 0")
    changed = part.select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"), (F.col("c_custkey") % 2 == 0).alias("_has_balance"))
    added = stored.where("c_custkey % 6 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("CHANGED").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(True).alias("_has_balance"))
    return R.upserted(stored, changed.unionByName(added), "c_custkey", {"c_acctbal": "_has_balance"})
