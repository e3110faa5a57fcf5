"""Text, search, vector, graph and evaluation queries, each with its oracle where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import arrays as A, dates as D, jsonx as J, text as T, vectors as V
from foliant.operators import chunking as C, evaluate as E, graph as G, mapping as M, models, parsing as X, search as S, validation as L
from foliant.sources import table

QUERIES: dict = {}
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


# text


@query("SELECT doc_id, contains(lower(text), 'the') AS has_the, len(string_split(lower(text), 'the')) - 1 AS n_the FROM documents WHERE contains(lower(text), 'the')")
def keyword_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(T.contains_any_case(F.col("text"), "the"))
    return docs.select("doc_id", T.contains_any_case(F.col("text"), "the").alias("has_the"), (F.size(F.split(F.lower("text"), "the")) - 1).cast("long").alias("n_the"))


@query("""SELECT doc_id, CASE WHEN p > 101 THEN '...' ELSE '' END || substr(text, greatest(p - 100, 1)::INT, (p + 2 + 100 - greatest(p - 100, 1) + 1)::INT) || CASE WHEN p + 102 < length(text) THEN '...' ELSE '' END AS snippet
  FROM (SELECT doc_id, text, position('and' IN lower(text)) AS p FROM documents) d WHERE p > 0""")
def kwic_first(spark, sf_dir):
    rows = X.with_snippets(table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("and"))).select("doc_id", "text"), "text", "and", 100)
    return rows.select("doc_id", F.col("snippets")[0].alias("snippet"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(\\n\\s*)+\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def newline_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_newlines(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short, left(text, 500) AS head, length(text)::INT AS n FROM documents")
def text_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text")).alias("short"), T.first_part(F.col("text"), 500).alias("head"), F.length("text").alias("n"))


@query("SELECT doc_id, regexp_replace(text, '(worthless|idiot)', '<span class=''highlight''>\\1</span>', 'gi') AS marked FROM documents WHERE regexp_matches(text, '(worthless|idiot)', 'i')")
def term_highlight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)(worthless|idiot)"))
    return docs.select("doc_id", T.highlighted(F.col("text"), ["idiot", "worthless"]).alias("marked"))


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS.format('lower(text)')}, lambda t: levenshtein(t, 'pathetic') <= 1)) > 0")
def fuzzy_term(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.near_term(F.col("text"), "pathetic", 1)).select("doc_id")


@query(f"SELECT doc_id, array_to_string(list_slice({_WORDS.format('text')}, 1, 200), ' ') AS context, greatest(len({_WORDS.format('text')}) - 200, 0)::INT AS num_truncated_tokens, round(coalesce(greatest(len({_WORDS.format('text')}) - 200, 0)::DOUBLE / nullif(len({_WORDS.format('text')}), 0), 0), 6) AS truncated_ratio FROM documents")
def context_truncation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"))
    return C.truncated(docs, 300, prompt_tokens=80, output_tokens=20).withColumn("truncated_ratio", F.round("truncated_ratio", 6))


@query("""SELECT doc_id, (i - 1)::INT AS chunk_id, length(substr(text, (1 + (i - 1) * 400)::INT, 512))::INT AS chunk_len, substr(text, (1 + (i - 1) * 400)::INT, 512) AS chunk_text
  FROM (SELECT doc_id, text, unnest(range(1, greatest(1, ceil((length(text) - 112) / 400.0))::INT + 1)) AS i FROM documents WHERE length(text) > 0) c""")
def chunk_fixed(spark, sf_dir):
    return C.fixed_chunks(table(spark, sf_dir, "documents"), 512, 112)


@query(None)
def chunk_recursive(spark, sf_dir):
    """All chunks of every document."""
    return C.chunk_documents(table(spark, sf_dir, "documents"), 512, 128, least_chars=50)


_CODES = "list_transform(range(6), lambda i: substr(sha256(doc_id::VARCHAR), (1 + i * 10)::INT, 10))"


@query(f"""WITH c AS (SELECT doc_id, {_CODES} AS c FROM documents), g AS (SELECT doc_id, [c[1] || ' ' || c[2], c[3] || ' ' || c[4] || chr(10) || c[5], c[6]] AS chunks FROM c)
  SELECT doc_id, (i - 1)::INT AS chunk_id, length(chunks[i])::INT AS chunk_len, chunks[i] AS chunk_text FROM (SELECT doc_id, chunks, unnest(range(1, 4)) AS i FROM g) t""")
def chunk_codes(spark, sf_dir):
    """The recursive splitter over paragraphs, lines and words of known lengths."""
    return C.chunk_documents(_code_texts(spark, sf_dir), 36)


def _code_texts(spark, sf_dir):
    digits = F.sha2(F.col("doc_id").cast("string"), 256)
    c = [F.substring(digits, 1 + i * 10, 10) for i in range(6)]
    text = F.concat(c[0], F.lit(" "), c[1], F.lit("\n\n"), c[2], F.lit(" "), c[3], F.lit("\n"), c[4], F.lit("\n\n"), c[5])
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"""WITH c AS (SELECT doc_id, {_CODES} AS c FROM documents), g AS (SELECT doc_id, [c[1] || ' ' || c[2], c[3] || ' ' || c[4] || chr(10) || c[5], c[6]] AS chunks FROM c)
  SELECT doc_id, (i - 1)::INT AS chunk_id, length(chunks[i])::INT AS chunk_len, chunks[i] AS chunk_text FROM (SELECT doc_id, chunks, unnest(range(1, 3)) AS i FROM g) t""")
def chunk_first_codes(spark, sf_dir):
    """The first two chunks of every document; its other chunks are never cut."""
    return C.chunk_documents(_code_texts(spark, sf_dir), 36, first_chunks=2)


@query(None)
def chunk_stats(spark, sf_dir):
    chunks = C.chunk_documents(table(spark, sf_dir, "documents").where(F.length("text") >= 100), 512, 128)
    per = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_len").alias("chars"))
    return per.agg(F.count(F.lit(1)).alias("n_docs"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("deviation"), F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_len"))


def _turn_lists(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS place, role, text AS content FROM conversations")
def conv_messages(spark, sf_dir):
    """Turns of a conversation as one message list with their unchanged texts, told as JSON and read again."""
    told = conv_messages_whole(spark, sf_dir).select("conv_id", F.from_json("messages", "array<struct<role:string,content:string>>").alias("m"))
    return told.select("conv_id", F.posexplode("m").alias("place", "_m")).select("conv_id", "place", "_m.role", "_m.content")


@query(None)
def conv_messages_whole(spark, sf_dir):
    """Turns of a conversation as one message list in JSON with their unchanged texts; null ones stay null."""
    messages = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return _turn_lists(spark, sf_dir).select("conv_id", F.to_json(messages, {"ignoreNullFields": "false"}).alias("messages"))


@query("""SELECT c_custkey, '{"name":' || to_json(c_name)::VARCHAR || ',"segment":' || to_json(c_mktsegment)::VARCHAR || '}' AS metadata FROM customer""")
def metadata_json(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return M.metadata_json(rows, ["c_custkey"]).select("c_custkey", "metadata")


@query("""SELECT c_custkey AS document_id, c_mktsegment AS title, CASE WHEN c_nationkey = 0 THEN -1 ELSE c_nationkey END AS nation, 'pl' AS language, c_name FROM customer""")
def map_with_defaults(spark, sf_dir):
    """Mapped and passed-through columns; a default replaces falsy values and a missing column."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return M.mapped(rows, {"c_custkey": "document_id", "c_mktsegment": "title", "c_nationkey": "nation"}, {"nation": -1, "language": "pl"})


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') || CASE WHEN
   (o_orderdate >= d.s AND o_orderdate < d.e) THEN '+02:00' ELSE '+01:00' END AS date FROM orders,
   LATERAL (SELECT make_date(year(o_orderdate), 3, 31) - ((extract('isodow' FROM make_date(year(o_orderdate), 3, 31)) % 7)::INT) + 1 AS s,
     CASE WHEN year(o_orderdate) <= 1995 THEN make_date(year(o_orderdate), 9, 30) - ((extract('isodow' FROM make_date(year(o_orderdate), 9, 30)) % 7)::INT) + 1
       ELSE make_date(year(o_orderdate), 10, 31) - ((extract('isodow' FROM make_date(year(o_orderdate), 10, 31)) % 7)::INT) + 1 END AS e) d""")
def dates_rfc3339(spark, sf_dir):
    """Dates as text in the zone's offset, summer time included."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.rfc3339(text)[0].alias("date"))


# search and vectors


def _bm25_sql(terms: list[str], limit: int) -> str:
    score = " + ".join(
        f"ln(1 + (n - (SELECT count(*) FROM d WHERE tf{i} > 0) + 0.5) / ((SELECT count(*) FROM d WHERE tf{i} > 0) + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms))
    )
    tfs = ", ".join(f"len(list_filter(w, lambda t: t = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH d AS (SELECT doc_id, len(w)::DOUBLE AS len, {tfs} FROM (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents WHERE text IS NOT NULL) x),
      s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM d) SELECT doc_id, round({score}, 6) AS score FROM d, s WHERE {some} ORDER BY {score} DESC, doc_id LIMIT {limit}"""


@query(_bm25_sql(["clown", "idiot", "worthless"], 20))
def bm25_topk(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), ["worthless", "idiot", "clown"], 20).withColumn("score", F.round("score", 6))


_QUERY = [((i * 37) % 17 - 8) / 10 for i in range(64)]
_DISTANCE = f"1 - list_dot_product(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_QUERY}::DOUBLE[], {_QUERY}::DOUBLE[])))"


@query(f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 25")
def vector_knn(spark, sf_dir):
    return S.nearest(table(spark, sf_dir, "embeddings"), _QUERY, 25).withColumn("distance", F.round("distance", 6))


@query(f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings WHERE {_DISTANCE} <= 0.95 ORDER BY {_DISTANCE}, vec_id LIMIT 1000")
def vector_range(spark, sf_dir):
    return S.nearest(table(spark, sf_dir, "embeddings"), _QUERY, 1000, 0.95).withColumn("distance", F.round("distance", 6))


def _fused_sql(most: int, vector: int, text: int) -> str:
    return f"""WITH v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_DISTANCE}, vec_id) - 1 AS rank FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY rank < {most}),
  t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM ({_bm25_sql(['clown', 'idiot', 'worthless'], most)}) b),
  u AS (SELECT coalesce(v.doc_id, t.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (v.rank + {vector} + 1), 0) AS vector_score, coalesce(1.0::DOUBLE / (t.rank + {text} + 1), 0) AS text_score FROM v FULL JOIN t ON v.doc_id = t.doc_id)
  SELECT doc_id, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score, round(vector_score + text_score, 6) AS score FROM u ORDER BY vector_score + text_score DESC, doc_id LIMIT 20"""


def _document_vectors(spark, sf_dir):
    """Vectors whose id is that of a document stand for it."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return vectors.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


@query(_fused_sql(20, 1, 2))
def hybrid_rrf(spark, sf_dir):
    """Vector and keyword lists of documents fused by reciprocal rank with priorities."""
    vectors = S.ranked(S.nearest(_document_vectors(spark, sf_dir), _QUERY, 20, key="doc_id"), [F.col("distance")], "doc_id")
    words = S.bm25(table(spark, sf_dir, "documents"), ["worthless", "idiot", "clown"], 20).withColumn("score", F.round("score", 6))
    both = S.fused(vectors, S.ranked(words, [F.desc("score")], "doc_id"), 20, "doc_id", 1.0, 2.0)
    return both.select("doc_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "text_score", "score")])


@query(_fused_sql(100, 1, 1))
def hybrid_search(spark, sf_dir):
    """The same in one call, without priorities, over the 100 best of each side."""
    found = S.hybrid(table(spark, sf_dir, "documents"), _document_vectors(spark, sf_dir), ["worthless", "idiot", "clown"], _QUERY, 20)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "text_score", "score")])


@query(f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 25 OFFSET 50")
def vector_page(spark, sf_dir):
    """The third page of a vector search."""
    return S.nearest(table(spark, sf_dir, "embeddings"), _QUERY, 25, offset=50).withColumn("distance", F.round("distance", 6))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents), q AS (SELECT unnest(['idiot', 'clown', 'scum']) AS query),
  r AS (SELECT doc_id, query, len(list_filter(w, lambda t: t = query)) AS score FROM w, q), h AS (SELECT * FROM r WHERE score > 0)
  SELECT doc_id, count(*) AS n_hits, array_to_string(list_sort(list(DISTINCT query)), ',') AS queries, sum(score)::BIGINT AS score FROM h GROUP BY doc_id HAVING count(DISTINCT query) >= 2""")
def multi_query_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.lower("text")).alias("w"))
    results = []
    for term in ("idiot", "clown", "scum"):
        hits = docs.select("doc_id", F.lit(term).alias("query"), F.lit("term").alias("kind"), S.occurrences("w", term).cast("long").alias("score"))
        results.append(hits.where("score > 0"))
    return S.merged_queries(results, "doc_id", 2).select("doc_id", "n_hits", F.array_join("queries", ",").alias("queries"), "score")




@query("SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) e GROUP BY label, pos")
def embedding_mean_by_label(spark, sf_dir):
    means = V.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("pos", "mean")).withColumn("mean", F.round("mean", 5))


@query("SELECT source, pos, round(sum(n * x) / sum(n), 5) AS mean FROM (SELECT source, n_chars AS n, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings JOIN documents ON vec_id = doc_id) e GROUP BY source, pos")
def embedding_weighted_mean(spark, sf_dir):
    joined = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars"), "vec_id")
    means = V.mean_vectors(joined, "source", "embedding", F.col("n_chars"))
    return means.select("source", F.posexplode("embedding").alias("pos", "mean")).withColumn("mean", F.round("mean", 5))


# graph: orders cite parts


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("judgment"), F.col("l_partkey").alias("base")).distinct()


@query("SELECT DISTINCT l_orderkey AS judgment, l_partkey AS base FROM lineitem")
def graph_edges(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("judgment")).agg(F.collect_list("l_partkey").alias("bases"))  # a few lines an order
    return G.bipartite_edges(lists, "judgment", "bases").withColumnRenamed("item", "base")


@query("SELECT degree, count(*) AS n FROM (SELECT l_partkey, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1) d GROUP BY degree")
def graph_degree(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir), "base").groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT DISTINCT l_orderkey AS judgment, l_partkey AS base FROM lineitem) SELECT judgment, base FROM e WHERE judgment IN (SELECT judgment FROM e WHERE base = 1)")
def graph_two_hop(spark, sf_dir):
    return G.two_hop(_edges(spark, sf_dir), spark.range(1, 2).withColumnRenamed("id", "base"), "judgment", "base")


@query("WITH e AS (SELECT DISTINCT l_orderkey AS judgment, l_partkey AS base FROM lineitem), s AS (SELECT count(*) AS n_edges, count(DISTINCT judgment) AS n_left, count(DISTINCT base) AS n_right FROM e) SELECT n_edges, n_left, n_right, n_left + n_right AS n_nodes, round_even(2.0::DOUBLE * n_edges / (n_left + n_right), 2) AS mean_degree FROM s")
def graph_stats(spark, sf_dir):
    return G.graph_stats(_edges(spark, sf_dir), "judgment", "base")


@query("SELECT c_custkey AS node, c_custkey AS component FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION SELECT o_orderkey + 1000000000, o_custkey FROM orders")
def graph_components(spark, sf_dir):
    """Components of the graph of customers and their orders: one per customer."""
    edges = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000000000).alias("src"), F.col("o_custkey").alias("dst"))
    return G.connected_components(edges)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part")
def node_indices(spark, sf_dir):
    return G.node_indices(table(spark, sf_dir, "part"), "p_partkey")


# evaluation: customers as records, predictions changed by key

_SCHEMA = {
    "balance": {"type": "number"},
    "segment": {"type": "enum", "choices": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"], "required": False},
    "tags": {"type": "list"},
    "name": {"type": "string"},
}


def _predictions(spark, sf_dir):
    """Every fifth answer lacks the balance, every seventh has another segment, every 11th cannot be parsed."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    gold = F.to_json(F.struct(F.floor("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.array(F.lit("a"), F.lit("a"), F.lit("b")).alias("tags"), F.lit("hello there").alias("name")))
    wrong = F.when(key % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment"))
    tags = F.when(key % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("a"), F.lit("b")))
    name = F.when(key % 3 == 0, "hello world").otherwise("hello there")
    answer = F.when(key % 5 == 0, F.to_json(F.struct(wrong.alias("segment"), tags.alias("tags"), name.alias("name")))).otherwise(F.to_json(F.struct(F.floor("c_acctbal").alias("balance"), wrong.alias("segment"), tags.alias("tags"), name.alias("name"))))
    answer = F.when(key % 11 == 0, "no json").otherwise(F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
    return c.select(key.alias("idx"), answer.alias("answer"), gold.alias("gold"))


_OK = "k % 11 <> 0"
_CELLS = [
    ("balance", "match", f"({_OK} AND k % 5 <> 0)::INT"),
    ("segment", "match", f"({_OK} AND k % 7 <> 0)::INT"),
    ("segment", "predicted_in_choices", f"({_OK} AND k % 7 <> 0 AND s IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'))::INT"),
    ("tags", "true_positives", f"CASE WHEN {_OK} THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END ELSE 0 END"),
    ("tags", "false_positives", f"({_OK} AND k % 2 = 0)::INT"),
    ("tags", "false_negatives", f"({_OK} AND k % 2 = 0)::INT"),
    *[("tags", m, f"CASE WHEN {_OK} THEN CASE WHEN k % 2 = 0 THEN 2.0 / 3 ELSE 1.0 END ELSE 0.0 END") for m in ("precision", "recall", "f1")],
    *[("name", m, f"CASE WHEN {_OK} THEN CASE WHEN k % 3 = 0 THEN {v} ELSE 1.0 END ELSE 0.0 END") for m, v in (("rouge1", 0.5), ("rouge2", 0.0), ("rougeL", 0.5))],
]
_SCORES_SQL = "WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer), e AS (" + " UNION ALL ".join(f"SELECT k AS idx, '{f}' AS field, '{m}' AS metric, ({v})::DOUBLE AS value FROM c" for f, m, v in _CELLS) + ")"


@query(_SCORES_SQL + " SELECT idx, field, metric, round(value, 6) AS value FROM e")
def eval_scores(spark, sf_dir):
    return E.score_records(_predictions(spark, sf_dir), _SCHEMA)[1].withColumn("value", F.round("value", 6))


@query(_SCORES_SQL + " SELECT field, metric, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS error, count(value) AS n FROM e GROUP BY field, metric HAVING count(value) >= 2")
def eval_mean_se(spark, sf_dir):
    means = E.mean_with_error(E.score_records(_predictions(spark, sf_dir), _SCHEMA)[1])
    return means.select("field", "metric", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"), "n")


@query(_SCORES_SQL + """, a AS (SELECT field, metric, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS error FROM e GROUP BY field, metric),
  r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY CASE metric WHEN 'f1' THEN 0 WHEN 'rougeL' THEN 1 WHEN 'match' THEN 2 ELSE 3 END, metric) AS rn FROM a)
  SELECT field, metric, round(mean, 6) AS mean, round(error, 6) AS error FROM r WHERE rn = 1""")
def eval_best_metric(spark, sf_dir):
    best = E.best_metric(E.mean_with_error(E.score_records(_predictions(spark, sf_dir), _SCHEMA)[1]))
    return best.select("field", "metric", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query("""SELECT count(*) AS total, count(*) FILTER (c_custkey % 11 <> 0) AS n_success, count(*) FILTER (c_custkey % 11 = 0) AS n_parsing_error, 0::BIGINT AS n_judge_error,
  1.0::DOUBLE AS mean_missing_keys, 0.0::DOUBLE AS mean_extra_keys FROM customer""")
def eval_status_stats(spark, sf_dir):
    return E.item_stats(E.score_records(_predictions(spark, sf_dir), _SCHEMA)[0])


@query("SELECT 'balance' AS key, count(*) AS n FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 11 <> 0")
def eval_missing_keys(spark, sf_dir):
    return E.key_frequency(E.score_records(_predictions(spark, sf_dir), _SCHEMA)[0], "missing_keys")


@query("""SELECT o_orderpriority AS llm, printf('%.3f', avg(m)) || ' (± ' || coalesce(printf('%.3f', stddev_samp(m)), 'nan') || ')' AS summary
  FROM (SELECT o_orderpriority, year(o_orderdate) AS seed, avg((o_orderstatus = 'F')::INT) AS m FROM orders GROUP BY ALL) r GROUP BY 1""")
def eval_llm_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("llm"), F.year("o_orderdate").alias("seed")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("value"))
    return E.run_summary(runs, ("llm",))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS a FROM conversations),
  x AS (SELECT p.conv_id, p.turn, p.a, g.a AS g, list_sum(list_transform(list_distinct(p.a), lambda t: least(len(list_filter(p.a, lambda y: y = t)), len(list_filter(g.a, lambda y: y = t)))))::DOUBLE AS hit
    FROM w p JOIN w g ON p.conv_id = g.conv_id AND p.turn = g.turn + 1)
  SELECT conv_id, turn, round(CASE WHEN coalesce(hit, 0) = 0 THEN 0.0::DOUBLE ELSE 2 * (hit / len(a)) * (hit / len(g)) / (hit / len(a) + hit / len(g)) END, 6) AS rouge1 FROM x""")
def eval_rouge1(spark, sf_dir):
    """Unigram F-measure of each turn against the turn before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.rouge_tokens(F.col("text")).alias("a"))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("g")), ["conv_id", "turn"])
    hit = A.multiset_overlap(F.col("a"), F.col("g"))
    return pairs.select("conv_id", "turn", F.round(A.token_f1(hit, F.size("a"), F.size("g"))[2], 6).alias("rouge1"))


@query("""SELECT c_custkey AS idx, (CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE (c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0 OR c_mktsegment = 'HOUSEHOLD')::INT END)::INT AS num_errors FROM customer""")
def validation_errors(spark, sf_dir):
    schema = {**_SCHEMA, "tags": {"type": "list", "items": {"type": "string"}}}
    return L.with_errors(_predictions(spark, sf_dir), "answer", schema).select("idx", "num_errors")


@query("SELECT unnest(['has_text', 'known_lang', 'short_enough']) AS rule, unnest(['CRITICAL', 'ERROR', 'WARNING']) AS level, unnest([a, b, c]) AS n_failed, unnest([a > 0, false, false]) AS blocks FROM (SELECT count(*) FILTER (NOT coalesce(text <> '', false)) AS a, count(*) FILTER (NOT coalesce(lang IN ('en', 'fr', 'de'), false)) AS b, count(*) FILTER (NOT coalesce(length(text) <= 10000, false)) AS c FROM documents) x")
def validation_report(spark, sf_dir):
    rules = [("has_text", "CRITICAL", F.col("text") != ""), ("known_lang", "ERROR", F.col("lang").isin("en", "fr", "de")), ("short_enough", "WARNING", F.length("text") <= 10000)]
    return L.rule_report(table(spark, sf_dir, "documents"), rules)


@query("""SELECT event_id, json_keys(props)[1] AS key, json_extract(props, '$.k')::INT AS k FROM events""")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.keys_of(F.col("props"))[0].alias("key"), F.try_variant_get(J.parsed_object(F.col("props")), "$.k", "int").alias("k"))


@query("""SELECT c_custkey, c_custkey AS kept FROM customer WHERE c_custkey % 3 <> 0""")
def json_any_value(spark, sf_dir):
    """Records whose every field is null are dropped."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("kept"))
    record = F.to_json(F.struct(F.col("kept").alias("a"), F.lit(None).cast("string").alias("b")), {"ignoreNullFields": "false"})
    return c.where(J.has_any_value(record))


@query("SELECT c_custkey, regexp_replace(c_name, '[^#]*#0*', '') AS number, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_mktsegment = 'MACHINERY' THEN 'm' ELSE 'other' END AS kind FROM customer")
def rewrite_and_map(spark, sf_dir):
    number = T.regex_rewritten(F.col("c_name"), [("[^#]*#0*", "")])
    kind = T.mapped(F.col("c_mktsegment"), {"building": "b", "MACHINERY": "m"}, F.lit("other"), any_case=True)
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), kind.alias("kind"))


@query(f"SELECT sum(n)::BIGINT AS input_tokens, round(sum(n) * 0.00015, 6) AS cost FROM (SELECT len({_WORDS.format('text')}) AS n FROM conversations) c")
def token_cost(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select(F.size(T.tokens(F.col("text"))).cast("long").alias("input_tokens"))
    return models.cost(tokens, {"input_tokens": 0.15}).withColumn("cost", F.round("cost", 6))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def leading_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.leading_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"))
