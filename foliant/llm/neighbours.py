"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced partitions with few edges between them; a
small network learns to tell a vector's partition from its components, with a bias for each partition
that makes its answers as balanced on the sample as the partitions are. Every vector is indexed in the
partition that the network finds most probable; where the counted vectors of a partition exceed its
capacity, the excess, by hash, goes to its next most probable partitions with room. A query is sent to its
several most probable partitions, whose vectors are all compared with it exactly. Partitions grow in
number with the root of the table. How many of them a query visits is calibrated for the wanted recall on
a part of the sample that the network is not trained on; it visits more where those hold fewer than ``k``
candidates.

A partition's vectors are cut into blocks by hash and stay in place; queries, the smaller side, are sent
to the blocks of the partitions that they visit and stream past each block, so a partition with a third
of all vectors is only more blocks. A block returns at most ``k`` rows per query.

Defined cases: vectors that are null, all zero, of another than the most common length or that hold
null or non-finite components take no part; rows without id take no part; a query's own id is no
candidate for it; repeated rows are candidates of their own and a repeated query id counts once; equal
distances are ordered by id; a query has as many rows as there are candidates, ``k`` at most; components may
be as large as a double, distances beyond it are infinite; an empty table gives no rows; further columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.llm.textops import ragged
from foliant.shipping import map_arrow
from foliant.storage import materialize

K = 10
EVERY = 100
#: Most vectors from which partitions are learned, and the share of them that only calibrates.
SAMPLE, ASIDE = 16384, 8
MOST_PARTITIONS, NEIGHBOURS, HIDDEN = 256, 10, 64
#: Share of true neighbours within the visited partitions of sampled queries.
WANTED = 0.95
#: Vectors of a block.
BLOCK = 8192
#: Vectors of a partition in proportion to the mean, and how many partitions are tried for a vector before any with room.
CAPACITY, CHOICES = 1.5, 6


def partition_count(rows: int, most: int = MOST_PARTITIONS) -> int:
    """The power of two below half the root of the rows, at least 1."""
    return min(most, 1 << max(0, int(np.sqrt(rows) / 2).bit_length() - 1))


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` nearest other vectors of each."""
    norms = (vectors**2).sum(axis=1)
    out = np.empty((len(vectors), k), dtype=np.int64)
    for lo in range(0, len(vectors), 1024):
        part = norms[None, :] - 2 * vectors[lo : lo + 1024] @ vectors.T
        part[np.arange(len(part)), lo + np.arange(len(part))] = np.inf
        out[lo : lo + 1024] = np.argpartition(part, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Balanced partition of the graph: halves along principal directions, then moves to the partition of
    most neighbours while it has room."""
    label = np.zeros(len(vectors), dtype=np.int64)
    level = 1
    while level < parts:
        for p in range(level):
            rows = np.flatnonzero(label == p)
            centred = vectors[rows] - vectors[rows].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = rows[np.argsort(centred @ direction, kind="stable")]
            label[order[len(order) // 2 :]] = p + level
        level *= 2
    n, room = len(vectors), int(np.ceil(slack * len(vectors) / level))
    sizes, rng = np.bincount(label, minlength=level), np.random.Generator(np.random.PCG64(seed))
    sources = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()))
    targets = np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    for _ in range(rounds):
        votes = np.bincount(sources * level + label[targets], minlength=n * level).reshape(n, level)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for i in rng.permutation(np.flatnonzero(gain > 0)):
            a, b = label[i], best[i]
            if a != b and sizes[b] < room:
                label[i], sizes[a], sizes[b], moved = b, sizes[a] - 1, sizes[b] + 1, moved + 1
        if not moved:
            break
    return label


def exponent(vectors: np.ndarray) -> int:
    """The power of two just above all magnitudes."""
    return int(np.frexp(np.abs(vectors).max(initial=0.0))[1])


@dataclass
class Router:
    """Most probable partitions of a vector. Vectors are first divided by a power of two, so squares stay finite."""

    centre: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    parts: int
    visits: int
    exponent: int = 0

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(vectors), 1))
        (w1, b1), (w2, b2) = self.layers
        scaled = np.clip(np.ldexp(vectors, -self.exponent), -1e6, 1e6)  # beyond the sample's range only direction counts
        return np.maximum((scaled - self.centre) @ w1 + b1, 0) @ w2 + b2

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")


def _learn(vectors: np.ndarray, targets: np.ndarray, hidden: int, epochs: int = 40, seed: int = 9) -> tuple[np.ndarray, list]:
    """Two layers fitted by Adam to the partitions of each vector's neighbours."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centre, spread = vectors.mean(axis=0), vectors.std() or 1.0
    x = (vectors - centre) / spread
    parameters = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, targets.shape[1])), np.zeros(targets.shape[1])]
    first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            rows = order[lo : lo + 256]
            h = np.maximum(x[rows] @ parameters[0] + parameters[1], 0)
            z = h @ parameters[2] + parameters[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - targets[rows]) / len(rows)
            dh = dz @ parameters[2].T * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                parameters[i] = parameters[i] - 0.003 * (0.5 if epoch > epochs // 2 else 1) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return centre, [(parameters[0] / spread, parameters[1]), (parameters[2], parameters[3])]


def balancing_bias(logits: np.ndarray, rounds: int = 60) -> np.ndarray:
    """What to add to each partition's logit so that the greatest ones are spread evenly."""
    parts = logits.shape[1]
    bias, mean, best, least = np.zeros(parts), len(logits) / parts, np.zeros(parts), np.inf
    step = logits.std() or 1.0
    for at in range(rounds):
        sizes = np.bincount((logits + bias).argmax(axis=1), minlength=parts)
        if sizes.max() < least:
            best, least = bias.copy(), sizes.max()
        bias -= step * np.log((sizes + 1) / (mean + 1)) / (3 + at / 4)
    return best


def fit_router(vectors: np.ndarray, parts: int, neighbours: int = NEIGHBOURS, wanted: float = WANTED, aside: int = ASIDE) -> Router:
    """Partitions, router and number of visits, from a sample; every ``aside``-th vector (but at least 64) only calibrates."""
    neighbours = min(neighbours, len(vectors) - 1)
    if parts < 2 or neighbours < 1:
        return Router(np.zeros(vectors.shape[1]), [], 1, 1)
    power = exponent(vectors)
    raw, vectors = vectors, np.ldexp(vectors, -power)
    graph = neighbour_graph(vectors, neighbours)
    label = balanced_parts(vectors, graph, parts)
    votes = np.bincount(np.repeat(np.arange(len(vectors)), neighbours) * parts + label[graph].ravel(), minlength=len(vectors) * parts).reshape(-1, parts)
    votes = votes + neighbours * np.eye(parts)[label]
    stride = max(1, min(aside, len(vectors) // 64))
    held = np.arange(len(vectors)) % stride == 0
    learnt = ~held if stride > 1 else held  # under 128 vectors all do both
    centre, layers = _learn(vectors[learnt], (votes / votes.sum(axis=1, keepdims=True))[learnt], HIDDEN)
    router = Router(centre, layers, parts, parts, power)
    weights, own = layers[1]
    router.layers[1] = (weights, own + balancing_bias(router.logits(raw)))
    ranked = router.ranked(raw)
    placed, position = ranked[:, 0], np.argsort(ranked[held], axis=1)
    needed = np.take_along_axis(position, placed[graph[held]], axis=1).ravel()
    covered = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    router.visits = int(np.searchsorted(covered, wanted) + 1)
    return router


def _stack(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(-1, width)


def _rank(shared, width: int, every: int):
    """The first choices of every vector, and of a query all partitions, most probable first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router: Router = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy()
            ranked = router.ranked(_stack(batch.column("embedding"), width)).astype(np.int32)
            asks = ids % every == 0
            first = ranked[:, :CHOICES]
            choices = ragged(first.ravel(), np.full(len(first), first.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), choices, ragged(ranked[asks].ravel(), np.where(asks, router.parts, 0), pa.int32())], ["vec_id", "embedding", "choices", "ranking"])

    return run


def with_capacity(ranked: DataFrame, parts: int, total: int, capacity: float = CAPACITY) -> Column:
    """The partition of every ranked vector: its first choice that has room.

    Of a partition that more vectors choose than it has room for, a share stays, by hash of the id, and the others go
    on to their next choice. Vectors that no choice has room for are dealt to the partitions that have. What is
    counted is one row a partition, once for each choice that is needed.
    """
    room = np.full(parts, float(np.ceil(capacity * total / parts)))
    unit = lambda i: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(i)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    kept: list[Column] = []
    for i in range(min(CHOICES, parts)):
        choice = F.col("choices")[i]
        open_ = ranked.where(F.coalesce(*kept).isNull()) if kept else ranked
        arrive = np.zeros(parts)
        for row in open_.groupBy(choice.alias("part")).count().collect():  # at most ``parts`` rows
            arrive[row["part"]] = row["count"]
        if not arrive.any():
            break
        share = np.minimum(1.0, room / np.maximum(arrive, 1))
        room = np.maximum(room - arrive, 0)
        kept.append(choice if share.min() == 1.0 else F.when(unit(i) < numbers(share)[choice], choice))
    edges = np.cumsum(room / max(room.sum(), 1.0))[:-1]
    return F.coalesce(*kept, F.size(F.filter(numbers(edges), lambda e: e <= unit(CHOICES)))).cast("int")


def _visit(sizes: np.ndarray, visits: int, k: int):
    """The partitions that a query visits: as many as calibrated, and until there are ``k`` candidates besides its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranked = batch.column("ranking").flatten().to_numpy().reshape(batch.num_rows, -1)
            held = np.cumsum(sizes[ranked], axis=1)
            short = (held < (k + batch.column("own").to_numpy())[:, None]).sum(axis=1) + 1
            counts = np.minimum(np.maximum(short, visits), ranked.shape[1])
            visited = ranked[np.arange(ranked.shape[1]) < counts[:, None]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), ragged(visited, counts, pa.int32())], ["vec_id", "embedding", "visits"])

    return run


def distances(known: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances to a query. Every difference is divided by a power of two and the result multiplied by it,
    which rounds as without, so squares neither overflow nor vanish."""
    gaps = known - query
    power = np.frexp(np.abs(gaps).max(axis=1, initial=0.0))[1]
    return np.ldexp(np.sqrt((np.ldexp(gaps, -power[:, None]) ** 2).sum(axis=1)), power)


def nearest_in(known_ids: np.ndarray, known: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query its id, the ids of its ``k`` nearest among ``known`` and their exact distances."""
    power = max(exponent(known), exponent(queries))
    scaled, out = np.ldexp(known, -power), []
    norms = (scaled**2).sum(axis=1)
    for lo in range(0, len(queries), 128):
        part = np.ldexp(queries[lo : lo + 128], -power)
        near = norms[None, :] - 2 * part @ scaled.T + (part**2).sum(axis=1)[:, None]
        own = query_ids[lo : lo + 128][:, None] == known_ids[None, :]
        near[own] = np.inf
        for q in range(len(part)):
            row = near[q]
            if len(row) > k:
                limit = np.partition(row, k - 1)[k - 1]
                found = np.flatnonzero(row <= limit + 1e-9 * (1 + abs(limit)) + 1e-9 * norms.max())
            else:
                found = np.arange(len(row))
            found = found[~own[q][found]]
            exact = distances(known[found], queries[lo + q])
            best = np.lexsort((known_ids[found], exact))[:k]
            out.append((np.full(len(best), query_ids[lo + q]), known_ids[found][best], exact[best]))
    return out


def _search(width: int, k: int):
    """Queries of a block stream past its vectors, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, i, asks, vec = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("part", "i", "asks", "vec_id"))
            cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (i[1:] != i[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if (part[a], i[a]) != block:
                    block, ids, vectors = (part[a], i[a]), [], []
                here = _stack(batch.column("embedding").slice(a, b - a), width)
                if not asks[a]:
                    ids.append(vec[a:b])
                    vectors.append(here)
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    found = nearest_in(ids[0], vectors[0], vec[a:b], here, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, parts: int | None = None, sample: int = SAMPLE, wanted: float = WANTED, block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id ``every`` divides.

    The router is learned from at most ``sample`` vectors, those with the smallest hashes of their ids.
    """
    spark = embeddings.sparkSession
    values = F.col("embedding")
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(F.col("vec_id").isNotNull() & values.isNotNull())
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.forall(values, number) & F.exists(values, lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = lengths["width"], lengths["count"]
    rows = rows.where(F.size("embedding") == width)
    chosen = rows.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "embedding").limit(sample).select("embedding").toPandas()["embedding"]
    router = fit_router(np.array([np.asarray(v, dtype=np.float64) for v in chosen]).reshape(-1, width), partition_count(total) if parts is None else parts, wanted=wanted)
    kind = embeddings.schema[vector].dataType.simpleString()
    ranked = map_arrow(rows, _rank(spark.sparkContext.broadcast(router), width, every), f"vec_id long, embedding {kind}, choices array<int>, ranking array<int>")
    ranked = materialize(ranked, "neighbours-index")
    placed = ranked.withColumn("part", with_capacity(ranked, router.parts, total))
    held = np.zeros(router.parts, dtype=np.int64)
    for row in placed.groupBy("part").count().collect():  # one row per partition
        held[row["part"]] = row["count"]
    sizes = F.broadcast(spark.createDataFrame([(p, max(1, -(-int(n) // block))) for p, n in enumerate(held)], "part int, blocks int"))
    asking = ranked.where(F.size("ranking") > 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "ranking")).alias("asked"), F.count("*").alias("own"))
    asking = map_arrow(asking.select("vec_id", "asked.embedding", "asked.ranking", "own"), _visit(held, router.visits, k), f"vec_id long, embedding {kind}, visits array<int>")
    asking = asking.select("vec_id", "embedding", F.explode("visits").alias("part"))
    known = placed.select("vec_id", "embedding", "part").join(sizes, "part").select("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int").alias("i"), "vec_id", "embedding", F.lit(False).alias("asks"))
    queries = asking.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "vec_id", "embedding", F.lit(True).alias("asks"))
    dealt = known.unionByName(queries).repartition("part", "i").sortWithinPartitions("part", "i", "asks")
    found = map_arrow(dealt, _search(width, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
