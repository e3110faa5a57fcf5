"""Profiling queries over the driver's tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foliant.functions import text as T
from foliant.operators import profile as P
from foliant.operators.relational import sample
from foliant.sources import table

QUERIES: dict = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


@query("""SELECT lang, source, n, round(n * 100.0 / sum(n) OVER (), 4) AS pct FROM (
  SELECT lang, source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang, source) g
  ORDER BY n DESC, lang, source LIMIT 10""")
def docs_topn_source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest (lang, source) groups of documents with text and their share of all."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return P.top(P.with_share(docs.groupBy("lang", "source").agg(F.count("*").alias("n"))), 10, "n", "lang", "source")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def doc_count_by_lang(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "documents"), ["lang"], drop_null=True)


@query("SELECT coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source, count(*) AS n FROM documents GROUP BY ALL")
def doc_count_by_lang_source(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "documents"), ["lang", "source"], null_as="<null>")


@query("""SELECT unnest(['text', 'lang', 'source', 'quality', 'toxic']) AS "column", unnest([a, b, c, d, e]) AS n_null,
  round(unnest([a, b, c, d, e])::DOUBLE / n, 4) AS null_ratio FROM (
  SELECT count(*) AS n, count(*) - count(text) AS a, count(*) - count(lang) AS b, count(*) - count(source) AS c, count(*) - count(quality) AS d, count(*) - count(toxic) AS e
  FROM documents LEFT JOIN labels USING (doc_id)) x""")
def docs_null_profile(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.null_profile(joined, ["text", "lang", "source", "quality", "toxic"], digits=4)


@query("""SELECT lang, round(avg((quality IS NULL)::INT), 6) AS missing_rate, round(avg(quality), 6) AS quality_mean, count(*) AS n
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def label_rate_by_lang(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.round(F.avg(F.col("quality").isNull().cast("int")), 6).alias("missing_rate"), F.round(F.avg("quality"), 6).alias("quality_mean"), F.count("*").alias("n"))


@query("""SELECT lang, count(length(text)) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean,
  round(quantile_cont(length(text), 0.5), 6) AS median, round(coalesce(stddev_samp(length(text)), 0), 6) AS deviation FROM documents GROUP BY lang""")
def docs_length_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("len", F.length("text").cast("long"))
    return P.summary(docs, "len", ["lang"])


@query("""SELECT round(quantile_cont(length(text), 0.25), 6) AS p25, round(quantile_cont(length(text), 0.5), 6) AS p50,
  round(quantile_cont(length(text), 0.75), 6) AS p75, round(quantile_cont(length(text), 0.95), 6) AS p95 FROM documents""")
def docs_length_quantiles(spark, sf_dir):
    return P.quantiles(table(spark, sf_dir, "documents").withColumn("len", F.length("text")), "len", [0.25, 0.5, 0.75, 0.95])


@query("""WITH b AS (SELECT least(floor(length(text) / 100.0), 49)::INT AS bin FROM documents WHERE length(text) BETWEEN 0 AND 5000),
  c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT bin, n, round(sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER (), 6) AS cumulative FROM c""")
def docs_length_hist(spark, sf_dir):
    """Documents of up to 5000 characters alone; ``docs_length_hist_whole`` has all."""
    return P.histogram(table(spark, sf_dir, "documents").withColumn("len", F.length("text")), "len", 0.0, 5000.0, 50)


@query("""WITH d AS (SELECT length(text)::DOUBLE AS x FROM documents), e AS (SELECT min(x) AS a, max(x) AS b, count(*) AS n_all FROM d),
  r AS (SELECT CASE WHEN a = b THEN a - 0.5::DOUBLE ELSE a END AS low, CASE WHEN a = b THEN 1.0::DOUBLE ELSE b - a END / 50.0::DOUBLE AS width, n_all FROM e WHERE a IS NOT NULL),
  c AS (SELECT least(floor((x - low) / width), 49)::INT AS bin, count(*) AS n FROM d, r WHERE x IS NOT NULL GROUP BY 1), i AS (SELECT unnest(range(50))::INT AS bin)
  SELECT bin, round(low + bin * width, 6) AS low, coalesce(n, 0) AS n, round(sum(coalesce(n, 0)) OVER (ORDER BY bin)::DOUBLE / n_all, 6) AS cumulative FROM i LEFT JOIN c USING (bin), r""")
def docs_length_hist_whole(spark, sf_dir):
    """Lengths of all documents in 50 bins from the least to the greatest."""
    return P.whole_histogram(table(spark, sf_dir, "documents").select(F.length("text").alias("len")), "len", 50)


@query("""WITH t AS (SELECT lang, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents)
  SELECT lang, count(n_tokens) AS n, min(n_tokens) AS least, max(n_tokens) AS most, round(avg(n_tokens), 6) AS mean,
  round(quantile_cont(n_tokens, 0.5), 6) AS median, round(coalesce(stddev_samp(n_tokens), 0), 6) AS deviation FROM t GROUP BY lang""")
def docs_token_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n_tokens", F.size(T.tokens(F.col("text"))).cast("long"))
    return P.summary(docs, "n_tokens", ["lang"])


@query("""SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates, count(*) = count(DISTINCT text) AS is_unique,
  round((SELECT sum(CASE WHEN k = 1 THEN 1 ELSE 0 END)::DOUBLE / sum(k) FROM (SELECT count(*) AS k FROM documents GROUP BY text) g), 6) AS unique_share FROM documents""")
def docs_uniqueness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    return P.uniqueness(docs, "digest")


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS word FROM documents) w
  GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def word_counts_top(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.lower("text"))).alias("word"))
    return P.top(words.groupBy("word").agg(F.count("*").alias("n")), 50, "n", "word")


@query("""SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) l
  WHERE line <> '' GROUP BY line HAVING count(*) > 1""")
def line_repeat_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    per_doc = lines.groupBy("line", "doc_id").agg(F.count("*").alias("k"))  # counted before lines meet
    return per_doc.groupBy("line").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs")).where("n > 1")


@query("SELECT n_turns, count(*) AS n FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) c GROUP BY n_turns")
def conv_length_distribution(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return turns.groupBy("n_turns").agg(F.count("*").alias("n"))


@query("""SELECT min(n_turns) AS least, max(n_turns) AS most, round(avg(n_turns), 6) AS mean, count(*) AS n_convs, sum(n_turns)::BIGINT AS n_rows, round(sum(chars)::DOUBLE / sum(n_turns), 6) AS mean_chars
  FROM (SELECT conv_id, count(*) AS n_turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) c""")
def conv_turn_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("chars"))
    return turns.agg(F.min("n_turns").alias("least"), F.max("n_turns").alias("most"), F.round(F.avg("n_turns"), 6).alias("mean"), F.count("*").alias("n_convs"), F.sum("n_turns").alias("n_rows"), F.round(F.sum("chars") / F.sum("n_turns"), 6).alias("mean_chars"))


@query("""SELECT round(count(*)::DOUBLE / count(DISTINCT conv_id), 6) AS ratio FROM conversations""")
def chunks_per_document(spark, sf_dir):
    """Rows of the detail table per parent, null without parents."""
    conv = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("k"))
    return conv.agg(F.round(F.try_divide(F.sum("k") * 1.0, F.count("*")), 6).alias("ratio"))


@query("SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1")
def orders_by_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n FROM orders GROUP BY ALL")
def orders_by_year_quarter(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.date_format(day, "yyyy-MM").alias("year_month")).agg(F.count("*").alias("n"))


_KINDS = ["click", "error", "purchase", "signup", "view"]
_COUNTS = ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in _KINDS)


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS period, {_COUNTS} FROM events GROUP BY 1")
def event_type_pivot(spark, sf_dir):
    return P.contingency(table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd"), "event_type", _KINDS)


@query("SELECT period, " + ", ".join(f'round(coalesce("{k}" * 100.0 / nullif({" + ".join(_KINDS)}, 0), 0), 4) AS "{k}"' for k in _KINDS) + f" FROM (SELECT strftime(ts, '%Y-%m-%d') AS period, {_COUNTS} FROM events GROUP BY 1) c")
def event_type_pct(spark, sf_dir):
    return P.contingency(table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd"), "event_type", _KINDS, percent=True)


@query("""SELECT user_id, round(a::DOUBLE / nullif(a + b, 0), 6) AS purchase_ratio FROM (
  SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id) c""")
def event_pivot_ratio(spark, sf_dir):
    """Pivot to columns, then a ratio that is null where both cells are missing."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["purchase", "view"]).agg(F.count(F.lit(1))).na.fill(0, ["purchase", "view"])
    return wide.select("user_id", F.round(F.try_divide(F.col("purchase") * 1.0, F.col("purchase") + F.col("view")), 6).alias("purchase_ratio"))


@query("""SELECT event_type, round(avg(k), 6) AS mean_k, count(*) AS n FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) e GROUP BY event_type""")
def event_props_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return events.groupBy("event_type").agg(F.round(F.avg("k"), 6).alias("mean_k"), F.count("*").alias("n"))


@query("""SELECT field, value, count(*) AS n FROM (SELECT unnest(['quality', 'toxic']) AS field, unnest([quality, toxic]) AS value FROM labels) u GROUP BY field, value""")
def unpivot_quality(spark, sf_dir):
    long = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "field", "value")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(quality::VARCHAR, 'None') AS gold, count(*) FILTER (coalesce(toxic::VARCHAR, 'None') = '0') AS "0", count(*) FILTER (coalesce(toxic::VARCHAR, 'None') = '1') AS "1",
  count(*) FILTER (coalesce(toxic::VARCHAR, 'None') = 'None') AS "None" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def confusion_quality_toxic(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.confusion(joined, "quality", "toxic", ["0", "1", "None"])


_DIMS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name"]


@query("WITH j AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), u AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS count FROM j WHERE {d} <> '' GROUP BY {d}" for d in _DIMS) + """),
  p AS (SELECT *, round(count * 100.0 / sum(count) OVER (PARTITION BY dimension), 4) AS percentage, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS rn FROM u)
  SELECT dimension, value, count, percentage FROM p WHERE rn <= 10""")
def multi_dim_analytics(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.dimensions(orders, _DIMS, most=10)


@query("SELECT min(o_orderdate) AS earliest, max(o_orderdate) AS latest, count(o_orderdate) AS n_dated FROM orders")
def order_date_range(spark, sf_dir):
    return P.date_range(table(spark, sf_dir, "orders"), "o_orderdate")


@query("""(SELECT p_partkey, p_retailprice, 'top' AS side FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30) UNION ALL
  (SELECT p_partkey, p_retailprice, 'bottom' AS side FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)""")
def top_and_bottom_k(spark, sf_dir):
    return P.top_and_bottom(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 30, 10)


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY lang, source)
  SELECT lang, arg_min(source, struct_pack(a := -n, b := source)) AS source, max(n) AS n FROM c GROUP BY lang""")
def most_frequent_source(spark, sf_dir):
    return P.most_frequent(table(spark, sf_dir, "documents"), "source", ["lang"])


@query("""SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS all_above, bool_or(c_acctbal < -990) AS any_low, count(*) FILTER (c_acctbal < 0) AS n_negative,
  round(avg((c_acctbal < 0 OR c_acctbal > 9000)::INT), 6) AS extreme_share FROM customer GROUP BY c_mktsegment""")
def boolean_aggregates(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.bool_and(b > -1000).alias("all_above"), F.bool_or(b < -990).alias("any_low"), F.count_if(b < 0).alias("n_negative"), F.round(F.avg(((b < 0) | (b > 9000)).cast("int")), 6).alias("extreme_share"))


@query("SELECT lang, source, n_chars, round(n_chars * 100.0 / sum(n_chars) OVER (PARTITION BY lang), 6) AS share FROM (SELECT lang, source, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang, source) s")
def share_within_group(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n_chars"))
    return sums.withColumn("share", F.round(F.col("n_chars") * 100.0 / F.sum("n_chars").over(Window.partitionBy("lang")), 6))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id LIMIT 100) s")
def docs_sample_deterministic(spark, sf_dir):
    """A sampling operator: 100 rows by seeded hash."""
    return sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id", 42)


@query("""SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS host FROM pages) p WHERE host <> '' GROUP BY host""")
def pages_host_counts(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1).alias("host")).where("host <> ''")
    return P.value_counts(hosts, ["host"])


@query("SELECT coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) AS valid, count(*) AS n FROM pages GROUP BY 1")
def pages_url_valid(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.is_url(F.col("url")).alias("valid")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n_docs, count(*) FILTER (n > 1000) AS n_truncated, round(avg(n) FILTER (n > 1000), 6) AS mean_tokens, round(avg((n - 1000)::DOUBLE / n) FILTER (n > 1000), 6) AS mean_ratio
  FROM (SELECT len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n FROM documents WHERE text IS NOT NULL) t""")
def truncation_stats(spark, sf_dir):
    """Means over truncated documents only."""
    _, cut, ratio = T.truncated_to_tokens(F.col("text"), F.lit(1000))
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.size(T.tokens(F.col("text"))).alias("n"), cut.alias("cut"), ratio.alias("ratio"))
    over = F.col("cut") > 0
    return docs.agg(F.count("*").alias("n_docs"), F.count_if(over).alias("n_truncated"), F.round(F.avg(F.when(over, F.col("n"))), 6).alias("mean_tokens"), F.round(F.avg(F.when(over, F.col("ratio"))), 6).alias("mean_ratio"))
