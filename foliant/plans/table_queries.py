"""Queries of checked joins, orders, pages, models, evaluation tables and graphs."""

from __future__ import annotations

import json

from pyspark.sql import Window, functions as F

from foliant.functions import vectors as V
from foliant.operators import chunking as C, evaluate as E, graph as G, models, profile as P, relational as R, search as S
from foliant.plans.registering import registrar, scratch
from foliant.sources import table

QUERIES, query = registrar()


# joins


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def exactly_one_match(spark, sf_dir):
    """Each row with its one match; several or none would raise."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.exactly_one(table(spark, sf_dir, "customer"), nation, "c_nationkey").select("c_custkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity, n_lines, o_totalprice FROM lineitem JOIN (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1) c ON k = l_orderkey JOIN orders ON o_orderkey = l_orderkey")
def counts_joined_back(spark, sf_dir):
    """Group sizes joined back to their rows, and attributes of the group."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    counts = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return lines.join(counts, "l_orderkey").join(orders, "l_orderkey")


_FULL = """l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name FROM part), r AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_brand FROM part)"""


@query(f"WITH {_FULL} SELECT l.i AS idx, p_name, p_brand FROM l JOIN r ON l.i = r.i")
def zipped_rows(spark, sf_dir):
    """Two tables of one length side by side by index."""
    parts = G.node_indices(table(spark, sf_dir, "part"), "p_partkey").withColumnRenamed("index", "idx")
    rows = table(spark, sf_dir, "part").join(parts, "p_partkey")
    return R.zipped(rows.select("idx", "p_name"), rows.select("idx", "p_brand"))


@query("""SELECT o_orderkey AS custom_id, CASE WHEN o_orderkey % 3 = 0 THEN 'success' WHEN o_orderkey % 3 = 1 THEN 'judge_error' ELSE 'parsing_error' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS result, CASE WHEN o_orderkey % 3 = 1 THEN 'late' END AS error FROM orders""")
def merged_batch_results(spark, sf_dir):
    """Requests of a batch with their result, else their error."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("custom_id"), "o_totalprice")
    results, errors = o.where("custom_id % 3 = 0").withColumnRenamed("o_totalprice", "result"), o.where("custom_id % 3 = 1").select("custom_id", F.lit("late").alias("error"))
    return R.merged_results(o.select("custom_id"), results, errors)


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def new_allowed_rows(spark, sf_dir):
    """Rows that are not stored yet, of allowed keys only."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    stored = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.new_rows(o, stored, "o_orderkey", o.where("o_custkey % 2 = 0")).select("o_orderkey")


@query("""SELECT c_custkey AS id, c_mktsegment AS segment_gold, CASE WHEN c_custkey % 4 <> 0 THEN upper(c_name) END AS segment_pred, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS score_judge FROM customer""")
def gold_prediction_and_judge(spark, sf_dir):
    """Gold, prediction and judgment side by side, each under its suffix."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    gold, predicted = c.select("id", F.col("c_mktsegment").alias("segment")), c.where("id % 4 <> 0").select("id", F.upper("c_name").alias("segment"))
    return R.side_by_side({"gold": gold, "pred": predicted, "judge": c.where("id % 5 <> 0").select("id", F.col("c_acctbal").alias("score"))}, "id")


@query("""SELECT o_orderpriority AS field, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "O", round(avg(o_totalprice) FILTER (o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'), 4) AS "P" FROM orders GROUP BY 1""")
def models_across(spark, sf_dir):
    """A column for each model, aligned by the field; one model lacks a field."""
    means = table(spark, sf_dir, "orders").where("NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')").groupBy(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("llm")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return R.across(means, ["field"], "llm", "mean", ["F", "O", "P"])


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k, event_type AS kind FROM events")
def nested_fields(spark, sf_dir):
    """Fields of a parsed record as columns of their own."""
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("kind")).alias("found"))
    return R.flattened(rows, "found")


@query("SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND quality = 1")
def rows_by_prediction(spark, sf_dir):
    """Rows whose joined prediction is present and has a wanted value."""
    predictions = table(spark, sf_dir, "labels").where("toxic is not null and quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(predictions, "doc_id")


@query("SELECT doc_id, item_id, round(n::DOUBLE / words, 4) AS share FROM (SELECT d.doc_id, b.item_id, length(b.text) AS n, length(d.text) AS words FROM documents d JOIN benchmark b ON contains(' ' || regexp_replace(d.text, '\\s+', ' ', 'g') || ' ', ' ' || b.text || ' ')) t")
def benchmark_passages(spark, sf_dir):
    """Documents that hold a whole benchmark passage, word by word, and its share of them.

    Documents and passages meet by the passages' first eight words, or all of a shorter one's; a document is probed
    with as many words as there are passages of.
    """
    head = lambda words, n: F.xxhash64(n, F.array_join(F.slice(words, 1, n), " "))
    first = F.least(F.size(F.split("text", " ")), F.lit(8))
    items = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("item"), first.alias("n"), head(F.split("text", " "), first).alias("h"))
    widths = sorted(r.n for r in items.select("n").distinct().collect())  # at most eight
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.split("text", r"\s+").alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(F.col("w"), i, n), " ")))).otherwise(F.array().cast("array<long>"))
    probes = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*[runs(n) for n in widths] or [F.array().cast("array<long>")]))).alias("h"))
    found = probes.join(items.select("item_id", "item", "h"), "h").select("doc_id", "item_id", "item").distinct()
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    both = found.join(docs.select("doc_id", "text"), "doc_id").where(F.contains(spaced(F.regexp_replace("text", r"\s+", " ")), spaced(F.col("item"))))
    return both.select("doc_id", "item_id", F.round(F.length("item") / F.length("text"), 4).alias("share"))


# orders and pages


@query("SELECT doc_id, (row_number() OVER (ORDER BY coalesce(length(text), 0) DESC, doc_id) - 1)::INT AS place FROM documents ORDER BY 2 LIMIT 200")
def longest_first(spark, sf_dir):
    """The longest texts, equally long ones in their old order."""
    rows = R.by_length(table(spark, sf_dir, "documents"), "text", "doc_id").limit(200)
    return rows.select("doc_id", F.row_number().over(Window.orderBy(F.coalesce(F.length("text"), F.lit(0)).desc(), "doc_id")).alias("place")).withColumn("place", F.col("place") - 1)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS place FROM documents ORDER BY doc_id LIMIT 200")
def order_restored(spark, sf_dir):
    """The old order of rows that were sorted by length."""
    rows = R.restored(R.by_length(table(spark, sf_dir, "documents"), "text", "doc_id"), "doc_id").limit(200)
    return rows.select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).alias("place"))


@query("SELECT p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) t WHERE rn <= 90")
def pages_of_results(spark, sf_dir):
    """Whole pages of 30 rows until 70 rows are reached."""
    return R.pages_up_to(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 70, 30, [F.desc("p_retailprice"), "p_partkey"])


@query("SELECT p_partkey FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) t WHERE rn BETWEEN 41 AND 60")
def one_page(spark, sf_dir):
    return R.page_at(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 40, 20, [F.desc("p_retailprice"), "p_partkey"]).select("p_partkey")


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || '#7'), c_custkey LIMIT 40")
def shuffled_rows(spark, sf_dir):
    """The first rows of a reproducible random order."""
    return R.shuffled(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7).limit(40)


@query("""WITH a AS (SELECT count(*) AS n FROM documents), b AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT count(DISTINCT text) AS n FROM documents)
  SELECT 'all' AS step, a.n, NULL::BIGINT AS change FROM a UNION ALL SELECT 'with text', b.n, b.n - a.n FROM a, b UNION ALL SELECT 'different', c.n, c.n - b.n FROM b, c""")
def sizes_of_steps(spark, sf_dir):
    """How many rows each step leaves, counted while the last one's result is written."""
    steps = {"all": lambda df: df, "with text": lambda df: df.where("text is not null"), "different": lambda df: df.select(F.sha2("text", 256).alias("digest")).distinct()}
    result, told = R.stepped(table(spark, sf_dir, "documents").select("text"), steps)
    result.write.parquet(scratch(spark, "steps"))
    return spark.createDataFrame(told(), "step string, n long, change long")


@query("SELECT o_custkey, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderstatus)) AS status, max(o_orderdate) > TIMESTAMP '1998-08-01' - INTERVAL 90 DAY AS recent FROM orders GROUP BY 1")
def last_checks(spark, sf_dir):
    """The last value of each key, and whether it is recent."""
    checked = R.checked_after(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderstatus", 90, F.lit("1998-08-01").cast("timestamp_ntz"))
    return checked.select("o_custkey", F.col("o_orderstatus").alias("status"), "recent")


# profiles


@query("""SELECT c_mktsegment, count(c_acctbal) AS n, 0::BIGINT AS n_null, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS deviation, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.25), 6) AS p25,
  round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.75), 6) AS p75, max(c_acctbal) AS most FROM customer GROUP BY 1""")
def described_balances(spark, sf_dir):
    return P.described(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"])


@query("SELECT min(o_orderdate) AS earliest, max(o_orderdate) AS latest, count(o_orderdate) AS n_dated, year(o_orderdate) AS year, count(*) AS n, (SELECT array_to_string(list(d::VARCHAR ORDER BY d), '|') FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders ORDER BY d LIMIT 5) s) AS sample FROM orders GROUP BY year(o_orderdate)".replace("min(o_orderdate)", "(SELECT min(o_orderdate) FROM orders)").replace("max(o_orderdate)", "(SELECT max(o_orderdate) FROM orders)").replace("count(o_orderdate)", "(SELECT count(o_orderdate) FROM orders)"))
def date_reports(spark, sf_dir):
    """Range of dates, counts by year and a sample."""
    report = P.date_report(table(spark, sf_dir, "orders"), "o_orderdate")
    return report.select("earliest", "latest", "n_dated", F.explode("by_year").alias("year", "n"), F.array_join(F.transform("sample", lambda d: d.cast("string")), "|").alias("sample"))


@query("WITH s AS (SELECT c_mktsegment AS v, count(*) AS c FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1), p AS (SELECT o_orderpriority AS v, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"
       " SELECT 'c_mktsegment' AS dimension, v AS value, c AS n, round_even(round(c * 100.0::DOUBLE / (SELECT sum(c) FROM s), 4), 1) AS percentage FROM (SELECT * FROM s ORDER BY c DESC, v LIMIT 3) a"
       " UNION ALL SELECT 'o_orderpriority', v, c, round_even(round(c * 100.0::DOUBLE / (SELECT sum(c) FROM p), 4), 1) FROM (SELECT * FROM p ORDER BY c DESC, v LIMIT 2) b"
       " UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*), NULL FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL SELECT 'unique', 'o_custkey', count(DISTINCT o_custkey), NULL FROM orders JOIN customer ON o_custkey = c_custkey")  # fmt: skip
def composed_response(spark, sf_dir):
    """One JSON answer of largest groups, counts by year and distinct values, taken apart again."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    told = P.response(joined, {"c_mktsegment": 3, "o_orderpriority": 2}, "o_orderdate", ["o_custkey"])
    groups = "array<struct<value:string,count:long,percentage:double>>"
    read = told.select(F.from_json("response", f"c_mktsegment {groups}, o_orderpriority {groups}, by_year map<string,long>, unique_o_custkey long").alias("r"))
    parts = [read.select(F.lit(d).alias("dimension"), F.inline(f"r.{d}")) for d in ("c_mktsegment", "o_orderpriority")]
    rows = parts[0].unionByName(parts[1]).withColumnRenamed("count", "n")
    years = read.select(F.lit("year").alias("dimension"), F.explode("r.by_year").alias("value", "n"), F.lit(None).cast("double").alias("percentage"))
    return rows.unionByName(years).unionByName(read.select(F.lit("unique").alias("dimension"), F.lit("o_custkey").alias("value"), F.col("r.unique_o_custkey").alias("n"), F.lit(None).cast("double").alias("percentage")))


@query("SELECT 'all' AS which, i::INT AS pos, round(avg(x), 5) AS mean FROM (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) t GROUP BY i UNION ALL SELECT 'none', i::INT, 0.0::DOUBLE FROM range(8) r(i)")
def mean_vectors(spark, sf_dir):
    """The mean of all vectors, and zeros where there are none."""
    e = table(spark, sf_dir, "embeddings").select("embedding")
    whole, none = V.mean_vector(e, "embedding"), V.mean_vector(e.where("false"), "embedding", 8)
    rows = whole.select(F.lit("all").alias("which"), F.posexplode("embedding").alias("pos", "mean")).unionByName(none.select(F.lit("none").alias("which"), F.posexplode("embedding").alias("pos", "mean")))
    return rows.withColumn("mean", F.round("mean", 5))


# models


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0] for t in texts]


def _first_letters(texts: list[str]) -> list[list[float]]:
    return [[float(ord(t[0])) if t else 0.0] for t in texts]


def _unable(texts: list[str]) -> list[list[float]]:
    raise RuntimeError("no model")


@query("SELECT c_custkey, length(c_name)::DOUBLE AS base, ascii(c_mktsegment)::DOUBLE AS fast, 0.0::DOUBLE AS broken FROM customer".replace("ascii(c_mktsegment)", "ascii(c_name)"))
def embeddings_of_models(spark, sf_dir):
    """Vectors of several models by name; a model that fails gives zeros."""
    rows = models.embed_all(table(spark, sf_dir, "customer"), "c_name", {"base": (_lengths, 2), "fast": (_first_letters, 1), "broken": (_unable, 3)})
    return rows.select("c_custkey", *[F.col(f"vectors.{n}")[0].cast("double").alias(n) for n in ("base", "fast", "broken")])


def _shout(prompts: list[str]) -> list[str]:
    if any("BUILDING" in p for p in prompts):
        raise ValueError("no buildings")
    return [p.upper() for p in prompts]


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN upper(left(c_name || ' of ' || c_mktsegment, 24)) END AS answer, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ValueError: no buildings' END AS error FROM customer")
def generated_answers(spark, sf_dir):
    """Answers of a model to capped prompts; a batch that keeps failing keeps its error."""
    c = table(spark, sf_dir, "customer").withColumn("prompt", F.concat("c_name", F.lit(" of "), "c_mktsegment"))
    return models.generate(c.select("c_custkey", "prompt"), "prompt", _shout, most_chars=32, attempts=2, batch=1, wait=0.0).select("c_custkey", F.left("answer", F.lit(24)).alias("answer"), "error")


def _judge(prompts: list[str]) -> list[str]:
    if any(p.endswith("0") for p in prompts):
        raise TimeoutError("late")
    return ["no json" if p.endswith("1") else json.dumps({"style": len(p), "facts": 0.5}) for p in prompts]


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'judge_error' WHEN c_custkey % 10 = 1 THEN 'parsing_error' ELSE 'success' END AS status, CASE WHEN c_custkey % 10 > 1 THEN length(c_name || c_custkey) ELSE 0 END::DOUBLE AS style, CASE WHEN c_custkey % 10 > 1 THEN 0.5 ELSE 0 END::DOUBLE AS facts FROM customer")
def judged_answers(spark, sf_dir):
    """A judge's scores; failed calls and unreadable answers are zeros."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.col("c_custkey").cast("string")).alias("prompt"))
    return models.judged(c, "prompt", _judge, ["style", "facts"], attempts=1, batch=1).select("c_custkey", "status", "scores.style", "scores.facts")


@query("SELECT c_custkey::VARCHAR AS custom_id, 'Rate ' || c_name || ' in ' || c_mktsegment AS content, 'gpt' AS model, 'number' AS kind, 'c_name|c_mktsegment' AS required FROM customer")
def judge_requests(spark, sf_dir):
    """Request lines for a batch of judgments."""
    c = table(spark, sf_dir, "customer")
    lines = models.judge_requests(c, "Rate {c_name} in {c_mktsegment}", ["c_name", "c_mktsegment"], "gpt", key="c_custkey")
    get = lambda path: F.get_json_object("request", path)
    form = "$.body.response_format.json_schema.schema"
    return lines.select("custom_id", get("$.body.messages[0].content").alias("content"), get("$.body.model").alias("model"), get(f"{form}.properties.c_name.type").alias("kind"), F.array_join(F.from_json(get(f"{form}.required"), "array<string>"), "|").alias("required"))


# evaluation


_FIELDS = {"day": {"type": "date"}, "price": {"type": "number"}, "status": {"type": "enum", "choices": ["F", "O", "P"]}, "words": {"type": "list"}, "note": {"type": "string"}, "other": {"type": "string"}}


def _answers(spark, sf_dir):
    """Items whose answers differ from gold in some fields; a key that gold lacks is a judge's error."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    gold = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.split("o_orderpriority", "-").alias("words"), F.concat("o_orderpriority", F.lit(" order of "), F.col("o_custkey").cast("string")).alias("note")))
    day = F.when(k % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"))
    answer = F.to_json(F.struct(day.alias("day"), F.col("o_totalprice").alias("price"), F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.array(F.split("o_orderpriority", "-")[0]).alias("words"), F.when(k % 5 != 0, F.concat(F.lit("order of "), F.col("o_custkey").cast("string"))).alias("note"), F.when(k % 7 == 0, "odd").alias("other")))
    answer = F.when(k % 13 == 0, "no answer").otherwise(answer)
    return o.select(k.alias("idx"), answer.alias("answer"), gold.alias("gold"))


def _scored(spark, sf_dir):
    return E.score_records(_answers(spark, sf_dir), _FIELDS)


_LIVE = "(o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0)"


@query(f"""SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 13 = 0 THEN 'parsing_error' WHEN o_orderkey % 7 = 0 THEN 'judge_error' ELSE 'success' END AS status, ({_LIVE} AND o_orderkey % 2 = 0)::INT::DOUBLE AS day, {_LIVE}::INT::DOUBLE AS price,
  ({_LIVE} AND o_orderkey % 3 <> 0)::INT::DOUBLE AS status_score, CASE WHEN {_LIVE} THEN 2.0 / (1 + len(string_split(o_orderpriority, '-'))) ELSE 0 END::DOUBLE AS words FROM orders""")
def judged_items(spark, sf_dir):
    """One row per item with a column for each field's metric."""
    return E.scored_items(_answers(spark, sf_dir), _FIELDS, {"day": ("day", "match"), "price": ("price", "match"), "status_score": ("status", "match"), "words": ("words", "f1")})


@query(f"""WITH n AS (SELECT o_orderkey, {_LIVE} AND o_orderkey % 5 <> 0 AS live, len(list_filter(string_split(regexp_replace(lower(o_orderpriority || ' order of ' || o_custkey), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS g FROM orders)
  SELECT o_orderkey AS idx, round(CASE WHEN live THEN 2.0 * 3 / (3 + g) ELSE 0 END, 6)::DOUBLE AS rouge1, round(CASE WHEN live THEN 2.0 * 2 / (2 + g - 1) ELSE 0 END, 6)::DOUBLE AS rouge2, round(CASE WHEN live THEN 2.0 * 3 / (3 + g) ELSE 0 END, 6)::DOUBLE AS "rougeL" FROM n""")
def text_scores(spark, sf_dir):
    """Overlap of an answer that is the end of the gold text."""
    table_ = E.scored_items(_answers(spark, sf_dir), _FIELDS, {c: ("note", c) for c in E.METRICS["string"]})
    return table_.select("idx", *[F.round(c, 6).alias(c) for c in E.METRICS["string"]])


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0) AS n_success, count(*) FILTER (o_orderkey % 13 = 0) AS n_parsing_error, count(*) FILTER (o_orderkey % 13 <> 0 AND o_orderkey % 7 = 0) AS n_judge_error,
  round_even(avg((o_orderkey % 5 = 0)::INT + (o_orderkey % 7 <> 0)::INT) FILTER (o_orderkey % 13 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0)), 3) AS mean_missing_keys, 0.0::DOUBLE AS mean_extra_keys FROM orders""")
def judged_statuses(spark, sf_dir):
    """Counts of all three statuses, and means over items with missing keys."""
    return E.item_stats(_scored(spark, sf_dir)[0])


@query(f"SELECT 'day' AS field, round(avg(({_LIVE} AND o_orderkey % 2 = 0)::INT), 6) AS mean, count(*) AS n FROM orders UNION ALL SELECT 'price', round(avg({_LIVE}::INT), 6), count(*) FROM orders")
def field_means(spark, sf_dir):
    """Unweighted means by field."""
    _, scores = _scored(spark, sf_dir)
    means = models.legacy_field_means(scores.where("metric = 'match' and field in ('day', 'price')"))
    return means.select("field", F.round("mean", 6).alias("mean"), "n")


@query("""WITH f AS (SELECT o_orderpriority AS llm, o_orderstatus AS field, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) / sqrt(count(*)) AS error FROM orders GROUP BY ALL HAVING count(*) >= 2)
  SELECT llm, round(avg(mean), 6) AS mean, count(*) AS n_fields, round(avg(mean) * 100, 4) AS percent, round(sqrt(sum(error * error)) / count(*) * 100, 4) AS error FROM f GROUP BY llm""")
def run_means(spark, sf_dir):
    """Means of field means by run, in percent with the error of independent fields."""
    fields = E.mean_with_error(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("llm"), F.col("o_orderstatus").alias("field"), F.col("o_totalprice").alias("value")), ("llm", "field"))
    errors = E.propagated_error(fields, ("llm",)).select("llm", F.round("mean", 4).alias("percent"), F.round("error", 4).alias("error"))
    return E.run_means(fields, ["llm"]).join(errors, "llm")


@query("""WITH r AS (SELECT lang AS query, n_chars::DOUBLE AS score FROM documents WHERE lang <> 'fr') SELECT q.query, count(score) AS n, coalesce(min(score), 0) AS least, coalesce(max(score), 0) AS most, round(coalesce(avg(score), 0), 6) AS mean
  FROM (SELECT DISTINCT lang AS query FROM documents WHERE lang IS NOT NULL) q LEFT JOIN r ON r.query = q.query GROUP BY q.query""")
def query_statistics(spark, sf_dir):
    """Scores of each query; zeros for one without results."""
    docs = table(spark, sf_dir, "documents")
    results = docs.where("lang <> 'fr'").select(F.col("lang").alias("query"), F.col("n_chars").cast("double").alias("score"))
    return S.query_stats(docs.where("lang is not null").select(F.col("lang").alias("query")).distinct(), results).withColumn("mean", F.round("mean", 6))


# search


_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def _bm25_sql(terms: list[str], limit: int, offset: int, text: str) -> str:
    score = " + ".join(f"ln(1 + (n - (SELECT count(*) FROM d WHERE tf{i} > 0) + 0.5) / ((SELECT count(*) FROM d WHERE tf{i} > 0) + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    tfs = ", ".join(f"len(list_filter(w, lambda t: t = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    return f"""WITH d AS (SELECT doc_id, len(w)::DOUBLE AS len, {tfs} FROM (SELECT doc_id, {_WORDS.format(text)} AS w FROM documents WHERE text IS NOT NULL OR source IS NOT NULL) x),
      s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM d) SELECT doc_id, round({score}, 6) AS score FROM d, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(terms)))} ORDER BY round({score}, 9) DESC, doc_id LIMIT {limit} OFFSET {offset}"""


_TERMS = ["idiot", "src3", "the"]


@query(_bm25_sql(_TERMS, 25, 10, "lower(coalesce(text, '') || ' ' || coalesce(source, ''))"))
def indexed_search(spark, sf_dir):
    """A page of a search over two fields, from a written index."""
    path = scratch(spark, "index")
    S.index(table(spark, sf_dir, "documents"), path, text=["text", "source"])
    return S.bm25_indexed(spark, path, _TERMS, 25, 10).withColumn("score", F.round("score", 6))


@query(_bm25_sql(_TERMS, 25, 10, "lower(coalesce(text, '') || ' ' || coalesce(source, ''))"))
def scanned_search(spark, sf_dir):
    """The same page without an index."""
    return S.bm25(table(spark, sf_dir, "documents"), _TERMS, 25, text=["text", "source"], offset=10).withColumn("score", F.round("score", 6))


@query(f"SELECT b.doc_id, b.score, regexp_replace(left(text, 200), '(worthless|idiot)', '<span class=''highlight''>\\1</span>', 'gi') AS highlight FROM ({_bm25_sql(['idiot', 'worthless'], 15, 0, 'lower(text)').replace('text IS NOT NULL OR source IS NOT NULL', 'text IS NOT NULL')}) b JOIN documents USING (doc_id)")
def highlighted_search(spark, sf_dir):
    """Scored results with their terms marked."""
    return S.highlighted_terms(table(spark, sf_dir, "documents"), ["idiot", "worthless"], 15).withColumn("score", F.round("score", 6))


# graphs


def _cites(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select((F.col("l_orderkey") + 1_000_000_000).alias("judgment"), F.col("l_partkey").alias("base")).distinct()


_CITES = "SELECT DISTINCT l_orderkey + 1000000000 AS judgment, l_partkey AS base FROM lineitem WHERE l_orderkey % 3 = 0"


@query("SELECT l_orderkey AS judgment, l_partkey AS item FROM lineitem GROUP BY ALL")
def edges_of_lists(spark, sf_dir):
    """Edges from lists of citations, once each."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("judgment")).agg(F.collect_list("l_partkey").alias("bases"))  # a few lines an order
    return G.bipartite_edges(lists, "judgment", "bases")


@query(f"WITH e AS ({_CITES}) SELECT judgment, base FROM e WHERE judgment % 2 = 0 AND base % 2 = 0")
def induced_graph(spark, sf_dir):
    edges = _cites(spark, sf_dir)
    nodes = edges.select(F.col("judgment").alias("node")).unionByName(edges.select(F.col("base").alias("node"))).distinct().where("node % 2 = 0")
    return G.induced(edges, nodes, "judgment", "base")


@query("""WITH RECURSIVE w AS (SELECT event_id AS a, event_id + 1 AS b FROM events WHERE event_id % 10 <> 9) SELECT event_id AS node, event_id - event_id % 10 AS component FROM events WHERE event_id // 10 * 10 + 9 <= (SELECT max(event_id) FROM events)""")
def components_of_chains(spark, sf_dir):
    """Components of long chains, whose edges are listed in a mixed order and direction."""
    ids = table(spark, sf_dir, "events").select("event_id").where("event_id % 10 <> 9")
    edges = ids.select(F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).otherwise(F.col("event_id")).alias("src"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).otherwise(F.col("event_id") + 1).alias("dst"))
    last = table(spark, sf_dir, "events").agg(F.max("event_id").alias("m"))
    return G.connected_components(edges).join(F.broadcast(last), F.expr("floor(node / 10) * 10 + 9 <= m")).select("node", "component")


@query("SELECT DISTINCT l_orderkey + 1000000000 AS u, l_partkey AS v FROM lineitem WHERE l_orderkey % 50 <> 0")
def giant_part(spark, sf_dir):
    """Edges of the largest component: some orders are cut off from all others, with parts of their own."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.when(F.col("l_orderkey") % 50 == 0, -1 - F.col("l_orderkey")).otherwise(F.col("l_partkey"))
    return G.giant_component(lines.select((F.col("l_orderkey") + 1_000_000_000).alias("u"), part.alias("v")).distinct(), "u", "v")


@query(f"""WITH e AS ({_CITES}), l AS (SELECT judgment, row_number() OVER (ORDER BY judgment) - 1 AS i FROM (SELECT DISTINCT judgment FROM e) a), r AS (SELECT base, row_number() OVER (ORDER BY base) - 1 AS i FROM (SELECT DISTINCT base FROM e) b)
  SELECT l.i AS left_index, r.i AS right_index FROM e JOIN l ON l.judgment = e.judgment JOIN r ON r.base = e.base""")
def edge_indices(spark, sf_dir):
    """Edges by the contiguous indices of both sides."""
    return G.edge_index(_cites(spark, sf_dir), "judgment", "base")[0]


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS index, round(embedding[1]::DOUBLE, 5) AS head, 64::INT AS n, row_number() OVER (ORDER BY vec_id) - 1 AS one_at FROM embeddings")
def node_features(spark, sf_dir):
    """A vector for each node of one side and an identity row for each of the other."""
    e = table(spark, sf_dir, "embeddings")
    nodes = G.node_indices(e, "vec_id")
    left, right = G.left_features(nodes, e, "vec_id", "embedding"), G.right_features(nodes)
    return left.join(right, "index").select("index", F.round(F.col("features")[0].cast("double"), 5).alias("head"), F.size("features").alias("n"), "one_at")


@query("SELECT 25::BIGINT AS n_on_both_sides, false AS bipartite, 5::BIGINT AS n_components, false AS connected".replace("25::BIGINT", "(SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT n_regionkey FROM nation))").replace("5::BIGINT AS n_comp", "(SELECT count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey > 4) AS n_comp"))
def graph_assertions(spark, sf_dir):
    """Whether a graph is connected and bipartite."""
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("u"), F.col("n_regionkey").cast("long").alias("v"))
    apart = edges.where("u > 4")
    return G.is_bipartite(edges, "u", "v").join(G.is_connected(apart, "u", "v"), F.lit(True))


def _rings(spark, sf_dir):
    """Rings of five customers, each whole, and one link between neighbouring rings: communities are the rings."""
    k = table(spark, sf_dir, "customer").select("c_custkey").where(F.expr("c_custkey < 100"))
    inner = k.alias("a").join(k.select(F.col("c_custkey").alias("other")), F.expr("floor(c_custkey / 5) = floor(other / 5) and c_custkey < other")).select(F.col("c_custkey").alias("u"), F.col("other").alias("v"))
    return inner.unionByName(k.where("c_custkey % 5 = 0 and c_custkey < 95").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 6).alias("v")))


@query("SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_custkey // 5) AS community FROM customer WHERE c_custkey < 100")
def graph_louvain(spark, sf_dir):
    """Communities by gains of modularity, named by their smallest node."""
    found = G.louvain(_rings(spark, sf_dir), "u", "v", resolution=1.0)
    names = found.groupBy("label").agg(F.min("node").alias("community"))
    return found.join(names, "label").select("node", "community")


@query("SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_custkey // 5) AS community FROM customer WHERE c_custkey < 100")
def graph_communities(spark, sf_dir):
    """Communities by propagation of labels until nothing changes."""
    found = G.label_propagation(_rings(spark, sf_dir), "u", "v")
    names = found.groupBy("label").agg(F.min("node").alias("community"))
    return found.join(names, "label").select("node", "community")


@query("WITH n AS (SELECT c_custkey AS k FROM customer WHERE c_custkey < 100), e AS (SELECT a.k AS u, b.k AS v FROM n a JOIN n b ON a.k // 5 = b.k // 5 AND a.k < b.k UNION ALL SELECT k, k + 6 FROM n WHERE k % 5 = 0 AND k < 95),"
       " d AS (SELECT c, count(*) AS k FROM (SELECT u // 5 AS c FROM e UNION ALL SELECT v // 5 FROM e) x GROUP BY c) SELECT round((SELECT count(*) FILTER (u // 5 = v // 5) / count(*) FROM e) - (SELECT sum(k * k) FROM d)::DOUBLE / (4.0 * (SELECT count(*) FROM e) ** 2), 6) AS modularity")  # fmt: skip
def graph_modularity(spark, sf_dir):
    edges = _rings(spark, sf_dir)
    return G.modularity(edges, G.louvain(edges, "u", "v"), "u", "v").select(F.round("modularity", 6).alias("modularity"))


@query("SELECT doc_id, count(*) AS n, min(length(c))::INT AS least, max(length(c))::INT AS most, round(avg(length(c)), 6) AS mean FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(1, ceil((length(text) - 112) / 400.0))::INT + 1), lambda i: substr(text, (1 + (i - 1) * 400)::INT, 512))) AS c FROM documents WHERE length(text) >= 100) t GROUP BY doc_id")
def chunk_summaries(spark, sf_dir):
    """Lengths of chunks by document, for documents of 100 characters or more."""
    return C.chunk_summary(C.fixed_chunks(table(spark, sf_dir, "documents").where(F.length("text") >= 100), 512, 112))
