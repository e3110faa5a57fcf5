"""Vector search over product-quantised codes, with exact reranking.

Vectors are scaled to length one and cut into parts; of every part a codebook of 256 centres is learned from a
bounded sample, and a vector's code is one byte a part. A search reads codes, an eighth of the vectors' bytes:
for every query, sums of table lookups rank all codes, the ten best for every wanted result become candidates,
and only the candidates' vectors are fetched and compared exactly.

Codes are dealt to blocks by hash and sorted before the queries that pass them; a block keeps no more than its
codes and gives at most the wanted candidates of a query. Queries are dealt to groups of bounded size, and every
group passes every block as a task of its own, so tasks grow in number and not in length.

Defined cases: null and zero vectors, those of another than the most common length and those with null or
non-finite components are neither found nor asked for; rows without key take no part; repeated keys are found
once, repeated queries answered once; equal distances are ordered by key; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foliant.functions import vectors as V
from foliant.shipping import map_arrow
from foliant.storage import materialize

#: Components of a part, centres of a codebook, and vectors from which codebooks are learned.
PART, CENTRES, SAMPLE = 2, 256, 16_384
#: Codes of a block, queries that pass it in one task, and candidates for a wanted result.
BLOCK, ASKING, CANDIDATES = 65_536, 8192, 10


def learned_codebooks(vectors: np.ndarray, part: int = PART, centres: int = CENTRES, rounds: int = 8, seed: int = 4) -> np.ndarray:
    """Centres by part (parts x centres x components) by k-means; missing components are zeros."""
    parts = -(-vectors.shape[1] // part)
    padded = np.zeros((len(vectors), parts * part))
    padded[:, : vectors.shape[1]] = vectors
    rng = np.random.Generator(np.random.PCG64(seed))
    books = np.empty((parts, centres, part))
    for p in range(parts):
        x = padded[:, p * part : (p + 1) * part]
        book = x[rng.choice(len(x), centres, replace=len(x) < centres)].copy()
        for _ in range(rounds):
            near = _nearest_centre(x, book)
            counts = np.bincount(near, minlength=centres)
            sums = np.stack([np.bincount(near, weights=x[:, c], minlength=centres) for c in range(part)], axis=1)
            book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
        books[p] = book
    return books


def _nearest_centre(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (((book**2).sum(axis=1)[None, :] - 2 * x @ book.T)).argmin(axis=1)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    values = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, initial=0.0))[1][:, None])
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def encoded(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """One byte a part of every vector."""
    parts, _, part = books.shape
    padded = np.zeros((len(vectors), parts * part))
    padded[:, : vectors.shape[1]] = vectors
    return np.stack([_nearest_centre(padded[:, p * part : (p + 1) * part], books[p]) for p in range(parts)], axis=1).astype(np.uint8)


def likeness(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Dot products of queries with coded vectors."""
    return _products(queries, decoded(codes, books))


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The centres that codes name, put together."""
    return np.concatenate([books[p].astype(np.float32)[codes[:, p]] for p in range(len(books))], axis=1)


def _products(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(queries), centres.shape[1]), dtype=np.float32)
    padded[:, : queries.shape[1]] = queries
    return padded @ centres.T


@dataclass
class Index:
    """Codebooks, the width of the vectors, and the written codes (``key, codes``)."""

    books: np.ndarray
    width: int
    codes: DataFrame


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector)
    return df.where(F.col(key).isNotNull() & v.isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0)).select(F.col(key).alias("key"), v.alias("vector"))


def _encode(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = encoded(_unit(batch.column("vector"), width), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([c.tobytes() for c in codes], pa.binary())], ["key", "codes"])

    return run


def build_index(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", part: int = PART, sample: int = SAMPLE) -> Index | None:
    """Codebooks from the ``sample`` vectors with the smallest hashes of their keys, and the codes of all. None without vectors."""
    rows = _usable(embeddings, key, vector)
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return None
    rows = rows.where(F.size("vector") == common["n"])
    chosen = rows.select("vector", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    books = learned_codebooks(_unit(chosen, common["n"]), part)
    kind = rows.schema["key"].dataType.simpleString()
    codes = map_arrow(rows, _encode(rows.sparkSession.sparkContext.broadcast(books), common["n"]), f"key {kind}, codes binary")
    return Index(books, common["n"], materialize(codes, "quantised-codes"))


def _candidates(shared, width: int, most: int, kind: pa.DataType):
    """Queries of a block stream past its codes, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, block, keys, codes, centres = shared.value, None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]), [True]))).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                if blocks[a] != block:
                    block, keys, codes = blocks[a], [], []
                here = batch.slice(a, b - a)
                if not asks[a]:
                    keys.append(here.column("key"))
                    codes.append(np.frombuffer(b"".join(here.column("codes").to_pylist()), np.uint8).reshape(b - a, -1))
                    continue
                if not keys:
                    continue
                if codes:
                    keys, centres, codes = [pa.concat_arrays(keys)], decoded(np.concatenate(codes), books), []
                for lo in range(0, b - a, 64):
                    part = here.slice(lo, 64)
                    found = _products(_unit(part.column("vector"), width), centres)
                    n = min(most, found.shape[1])
                    best = np.argpartition(-found, n - 1, axis=1)[:, :n]
                    which = np.repeat(np.arange(part.num_rows), n)
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(which)), keys[0].take(pa.array(best.ravel())), pa.array(np.take_along_axis(found, best, axis=1).ravel().astype(np.float64))], ["query", "key", "likeness"])

    return run


def search(index: Index | None, embeddings: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, block: int = BLOCK, asking: int = ASKING) -> DataFrame:
    """``query, rank, key, distance``: the nearest of every query (columns ``key`` and ``vector``) by cosine, itself excepted."""
    spark, kind = embeddings.sparkSession, embeddings.schema[key].dataType
    if index is None:
        return spark.createDataFrame([], f"query {kind.simpleString()}, rank int, key {kind.simpleString()}, distance double")
    blocks = max(1, -(-index.codes.count() // block))
    empty = F.lit(None).cast(embeddings.schema[vector].dataType)
    asked = _usable(queries, key, vector).where(F.size("vector") == index.width).groupBy("key").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-asked.count() // asking))
    place = lambda block, group: (block * groups + group).cast("int").alias("block")
    hashed = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = index.codes.select("key", "codes", upto(groups).alias("g")).select(place(hashed(blocks), F.col("g")), F.lit(False).alias("asks"), "key", "codes", empty.alias("vector"))
    asks = asked.select("key", "vector", upto(blocks).alias("b")).select(place(F.col("b"), hashed(groups)), F.lit(True).alias("asks"), "key", F.lit(None).cast("binary").alias("codes"), "vector")
    dealt = known.unionByName(asks).repartition(blocks * groups, "block").sortWithinPartitions("block", "asks")
    most = limit * candidates + 1  # with itself
    told = map_arrow(dealt, _candidates(spark.sparkContext.broadcast(index.books), index.width, most, None), f"query {kind.simpleString()}, key {kind.simpleString()}, likeness double")
    best = Window.partitionBy("query").orderBy(F.desc("likeness"), "key")
    told = told.where("query <> key").withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= limit * candidates).select("query", "key").distinct()
    vectors = _usable(embeddings, key, vector).groupBy("key").agg(F.min("vector").alias("v"))
    pairs = told.join(vectors, "key").join(asked.select(F.col("key").alias("query"), F.col("vector").alias("q")), "query")
    near = pairs.select("query", "key", V.cosine_distance(F.col("q"), F.col("v")).alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", F.col("rank").cast("int").alias("rank"), "key", "distance")
