"""Keyword, vector and hybrid search.

BM25 uses k1 = 1.2 and b = 0.75 with the idf ``ln(1 + (N - df + 0.5) / (df + 0.5))``. Vector search is exact
and by cosine distance. Ranks start at 0; equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from foliant.functions import text as T, vectors as V
from foliant.storage import materialize, parts_of

K1, B = 1.2, 0.75


def occurrences(words: Column | str, term: str) -> Column:
    return F.size(F.filter(words, lambda t: t == term))


def postings(docs: DataFrame, key: str, text: str | Sequence[str]) -> DataFrame:
    """``term, key, tf, length`` of lower-case tokens of one or several fields taken together."""
    fields = [text] if isinstance(text, str) else list(text)
    words = F.flatten(F.array(*[T.tokens(F.lower(f)) for f in fields]))
    known = docs.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
    # a document's equal words are neighbours once sorted, so they are counted in its row, without a shuffle
    begins = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
    runs = lambda w, s: F.transform(s, lambda x, i: F.struct(F.get(w, x - 1).alias("term"), (F.coalesce(F.get(s, i + 1), F.size(w) + 1) - x).cast("long").alias("tf")))
    counted = F.transform(F.array(F.sort_array(words)), lambda w: F.struct(F.size(w).alias("length"), F.when(F.size(w) > 0, F.transform(F.array(begins(w)), lambda s: runs(w, s))[0]).alias("terms")))[0]
    rows = known.select(F.col(key), counted.alias("_d")).select(key, "_d.length", F.explode("_d.terms").alias("_r"))
    return rows.select(key, "_r.term", "length", "_r.tf")


def index(docs: DataFrame, path: str, key: str = "doc_id", text: str | Sequence[str] = "text", files: int | None = None) -> None:
    """Write postings, sorted by term so that a query's terms prune row groups, and the statistics of the documents."""
    fields = [text] if isinstance(text, str) else list(text)
    files = files or parts_of(docs) or 2 * docs.sparkSession.sparkContext.defaultParallelism
    postings(docs, key, text).repartitionByRange(files, "term", key).sortWithinPartitions("term", key).write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/postings")
    lengths = docs.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull()).select(F.size(F.flatten(F.array(*[T.tokens(F.lower(f)) for f in fields]))).alias("l"))
    lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/documents")


def _scored(hits: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Summed BM25 of postings that hold a query's terms."""
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))  # a row for each term of the query
    idf = F.log(1 + (F.col("n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(stats)).groupBy(key).agg(F.sum(score).alias("score"))


def bm25_indexed(spark: SparkSession, path: str, terms: Sequence[str], limit: int, offset: int = 0, key: str = "doc_id") -> DataFrame:
    """``key, score`` of one page of the best documents of a written index; terms are counted once each."""
    wanted = sorted({t.lower() for t in terms})
    hits = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(*wanted))
    return _scored(hits, spark.read.parquet(f"{path}/documents"), key).orderBy(F.desc("score"), key).offset(offset).limit(limit)


def bm25(docs: DataFrame, terms: Sequence[str], limit: int, key: str = "doc_id", text: str | Sequence[str] = "text", offset: int = 0) -> DataFrame:
    """``key, score`` of one page of the best documents for a query, in one pass without an index.

    Term frequencies are found per row with array functions and every document leaves the scan as a few
    numbers; matching ones become rows.
    """
    fields = [text] if isinstance(text, str) else list(text)
    words = F.flatten(F.array(*[T.tokens(F.lower(f)) for f in fields]))
    wanted = sorted({t.lower() for t in terms})
    known = docs.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
    rows = known.select(F.col(key), F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("length"), F.array(*[occurrences(w, x) for x in wanted]).alias("tfs")))[0].alias("_d"))
    rows = materialize(rows.select(key, "_d.length", "_d.tfs"), "bm25-counts")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))  # one row
    hits = rows.where(F.exists("tfs", lambda t: t > 0)).select(key, "length", F.posexplode("tfs").alias("_at", "tf")).where("tf > 0")
    return _scored(hits.withColumn("term", F.array(*[F.lit(t) for t in wanted])[F.col("_at")]), stats, key).orderBy(F.desc("score"), key).offset(offset).limit(limit)


def highlighted_terms(docs: DataFrame, terms: Sequence[str], limit: int, key: str = "doc_id", text: str = "text", shown: int = 200) -> DataFrame:
    """``key, score, highlight`` of the best documents: the beginning of the text with its terms marked."""
    best = bm25(docs, terms, limit, key, text)
    found = docs.join(F.broadcast(best), key)  # ``limit`` rows
    return found.select(key, "score", T.highlighted(F.left(text, F.lit(shown)), list(terms)).alias("highlight")).orderBy(F.desc("score"), key)


def nearest(embeddings: DataFrame, query: Sequence[float], limit: int, most_distance: float | None = None, key: str = "vec_id", vector: str = "embedding", offset: int = 0) -> DataFrame:
    """``key, distance`` of the nearest vectors to a literal query, up to a distance."""
    rows = embeddings.select(key, V.cosine_distance(F.col(vector), V.literal_vector(list(query))).alias("distance")).where(F.col("distance").isNotNull())
    if most_distance is not None:
        rows = rows.where(F.col("distance") <= most_distance)
    return rows.orderBy("distance", key).offset(offset).limit(limit)


def ranked(results: DataFrame, order: Sequence, key: str) -> DataFrame:
    """Zero-based ranks within a limited result list."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order, key)) - 1)


def fused(vector_results: DataFrame, text_results: DataFrame, limit: int, key: str, vector_priority: float = 1.0, text_priority: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two lists with ``rank``: ``1 / (rank + priority + 1)`` summed per key."""
    sides = [(vector_results, vector_priority, "vector_score"), (text_results, text_priority, "text_score")]
    scored = [df.select(key, *[(1 / (F.col("rank") + p + 1) if name == mine else F.lit(None).cast("double")).alias(name) for _, _, name in sides]) for df, p, mine in sides]
    both = scored[0].unionByName(scored[1]).groupBy(key).agg(*[F.coalesce(F.max(name), F.lit(0.0)).alias(name) for _, _, name in sides])
    return both.withColumn("score", F.col("vector_score") + F.col("text_score")).orderBy(F.desc("score"), key).limit(limit)


def hybrid(docs: DataFrame, embeddings: DataFrame, terms: Sequence[str], query: Sequence[float], limit: int, key: str = "doc_id", text: str = "text", vector: str = "embedding", most: int = 100) -> DataFrame:
    """Documents by keyword and by vector, fused by reciprocal rank; both tables share the key."""
    near = ranked(nearest(embeddings, query, most, key=key, vector=vector), [F.col("distance")], key)
    words = ranked(bm25(docs, terms, most, key, text), [F.desc(F.round("score", 6))], key)
    return fused(near, words, limit, key)


def merged_queries(results: Sequence[DataFrame], key: str, least: int = 1) -> DataFrame:
    """Results of several queries (``key, query, kind, score``) as one row per key: number of hits, sorted
    distinct queries and kinds, summed score; keys with fewer than ``least`` queries are dropped."""
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    merged = every.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.collect_set("query")).alias("queries"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("score").alias("score"))
    return merged.where(F.size("queries") >= least)


def query_stats(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Count, least, most and mean score of each query; zeros for queries without results."""
    stats = results.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean"))
    return queries.join(stats, "query", "left").na.fill(0, ["n", "least", "most", "mean"])
