"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles of five words; two are linked if their sets' Jaccard similarity
reaches the threshold. Texts with one shingle set form one class of copies, represented by the
smallest id.

1. Every document gets a MinHash signature; representatives with an equal band of it share a bucket.
   A pair at the threshold misses all bands with a probability of 1e-7.
2. Pairs of a bucket are screened by their sketches (band fingerprints and one byte of each MinHash
   value). A pair counts in the first band that it shares, so once. Its values are compared some at a
   time: with m of n equal and a uniform prior, the posterior probability that the similarity reaches
   the threshold is a binomial sum, and pairs below the tolerance are dropped. Equal bytes of unequal
   values only keep pairs. Documents with a pair left go on, with their bucket.
3. Shingle sets of these documents meet in these buckets and the pairs left are verified exactly.
   Classes are the components of verified links alone.

A large bucket is cut into blocks and every pair of blocks is a task's work of its own, so no task holds
a whole bucket. A task returns per document its number of links and the smallest linked document: the
links of thousands of near copies are counted, never written as pairs.

Defined cases: a text of under five words is one shingle of all of them; texts without words are
linked to nothing; rows without id are linked to nothing and keep a null class; repeated rows count
as copies of each other; texts that share an id are compared like any others; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.textops import ragged, rolling, scramble, sorted_groups, text_chunks, word_bounds, word_hashes
from foliant.operators.graph import connected_components
from foliant.shipping import map_arrow
from foliant.storage import materialize, parts_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
#: Values compared between two looks at the posterior.
STEP = 20
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-9
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Buckets of several blocks whose table is broadcast.
_BROADCAST_ROWS = 200_000
_U = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = np.random.Generator(np.random.PCG64(78)).integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a buffer."""
    starts, ends, at = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    runs = rolling(hashes, shingle)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:
            out.append(rolling(hashes[a:b], b - a) ^ _U(b - a))
        else:
            out.append(hashes[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a nonempty set under random odd multiples of its hashes."""
    low = (shingles >> _U(16)).astype(np.uint32)
    best = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        part = _FACTORS[:, None] * low[None, i : i + 2048]
        part += _SHIFTS[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def _set_digest(shingles: np.ndarray) -> tuple[int, int]:
    a, b = scramble(shingles), scramble(shingles ^ _U(0x5851F42D4C957F2D))
    return int(a.sum(dtype=_U).view(np.int64)), int((np.bitwise_xor.reduce(b) + _U(len(shingles))).view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = scramble(np.arange(1, BANDS + 1, dtype=_U))
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column(1)):
            rows, first, second, sizes, bands, sketches = [], [], [], [], [], []
            for row, shingles in enumerate(shingle_sets(data, offsets)):
                if not len(shingles):
                    continue
                values = signature(shingles)
                parts = values.reshape(BANDS, ROWS).astype(_U)
                keys = salt.copy()
                for j in range(ROWS):
                    keys = scramble(keys * _U(0x9E3779B97F4A7C15) + parts[:, j])
                a, b = _set_digest(shingles)
                rows.append(lo + row)
                first.append(a)
                second.append(b)
                sizes.append(len(shingles))
                bands.append(keys.view(np.int64))
                sketches.append(keys.astype(np.uint32).tobytes() + values.astype(np.uint8).tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int32()),
                    ragged(np.concatenate(bands), [BANDS] * len(rows), pa.int64()), pa.array(sketches, pa.binary()),
                ], ["doc_id", "digest", "set_a", "set_b", "n", "bands", "sketch"])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of nodes."""
    for batch in batches:
        nodes = batch.column("node")
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([nodes.slice(lo, hi - lo), pa.array([x.tobytes() for x in shingle_sets(data, offsets)], pa.binary())], ["node", "shingles"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, most: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """For each number of compared values, the fewest matches with which a pair stays."""
    out = []
    for n in range(step, most + 1, step):
        posterior, m = 0.0, -1
        while posterior < tolerance:
            m += 1
            posterior += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def pairs_within(groups: np.ndarray, blocks: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group, ``groups`` being sorted; where ``apart`` is set, of different blocks only."""
    cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    later = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(groups)) - 1
    i = np.repeat(np.arange(len(groups)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    keep = ~apart[i] | (blocks[i] != blocks[j])
    return i[keep], j[keep]


def screened(sketches: np.ndarray, bands: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose first shared band is that of their bucket and whose values leave the threshold possible.

    ``sketches`` has a row of bytes for each document, ``bands`` its bucket's band.
    """
    marks = np.ascontiguousarray(sketches[:, : 4 * BANDS]).view(np.uint32).T.copy()
    values = sketches[:, 4 * BANDS :].T.copy()
    done, band = [], bands[i]
    for c in range(BANDS):
        here = band == c
        if here.any():
            done.append((i[here], j[here]))
        keep = ~here & (marks[c][i] != marks[c][j])
        i, j, band = i[keep], j[keep], band[keep]
        if not len(i):
            break
    i, j = (np.concatenate(x) for x in zip(*done)) if done else (i, j)
    matches, at = np.zeros(len(i), dtype=np.int16), 0
    for n, least in least_matches(threshold, tolerance):
        for k in range(at, n):
            matches += values[k][i] == values[k][j]
        at = n
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of shingle sets that reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = small >= threshold * large - 1e-9  # no overlap can reach it otherwise
    i, j = i[keep], j[keep]
    if not len(i):
        return i, j
    used = np.unique(np.concatenate((i, j)))
    _, codes = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    where = np.concatenate(([0], np.cumsum(sizes[used])))
    slot = np.full(len(sets), -1)
    slot[used] = np.arange(len(used))
    present = np.zeros(int(codes.max()) + 1, dtype=bool)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    good = np.zeros(len(i), dtype=bool)
    cuts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = codes[where[slot[i[a]]] : where[slot[i[a]] + 1]]
        present[own] = True
        for p in range(a, b):
            other = codes[where[slot[j[p]]] : where[slot[j[p]] + 1]]
            common = int(np.count_nonzero(present[other]))
            good[p] = common / (len(own) + len(other) - common) >= threshold
        present[own] = False
    return i[good], j[good]


def _candidates(table: pa.Table, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    key, a, b, blocks = (table.column(x).to_numpy() for x in ("key", "i", "j", "block"))
    groups = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    i, j = pairs_within(groups, blocks, a != b)
    sketches = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("sketch")])
    return screened(sketches, table.column("band").to_numpy(), i, j, threshold, tolerance)


def _screen(threshold: float, tolerance: float):
    """Documents with a pair left, and the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["key", "i", "j"], BLOCK_DOCS, 1 << 20):
            i, j = _candidates(table, threshold, tolerance)
            if len(i):
                yield from table.select(["key", "band", "node"]).take(np.unique(np.concatenate((i, j)))).combine_chunks().to_batches()

    return run


def _verify(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["key", "i", "j"], BLOCK_DOCS, 4 * BLOCK_SHINGLES):
            repeated = np.ones(table.num_rows, dtype=bool)  # a node may have its set from several equal rows
            for name in ("key", "i", "j", "node"):
                column = table.column(name).to_numpy()
                repeated[1:] &= column[1:] == column[:-1]
            repeated[:1] = False
            table = table.filter(pa.array(~repeated)) if repeated.any() else table
            i, j = _candidates(table, threshold, tolerance)
            nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), dtype=_U) for x in table.column("shingles")]
            x, y = verified(sets, i, j, threshold)
            if not len(x):
                continue
            links = np.zeros(len(nodes), dtype=np.int64)
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            root = np.arange(len(nodes))
            while True:
                low = np.minimum(root[x], root[y])
                new = root.copy()
                np.minimum.at(new, x, low)
                np.minimum.at(new, y, low)
                new = new[new]
                if np.array_equal(new, root):
                    break
                root = new
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes[has], nodes[root[has]], links[has])], ["node", "root", "links"])

    return run


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` of ``key, node`` once for each pair ``i, j`` of its bucket's blocks that holds its own block.

    ``blocks`` tells the number of blocks by key. Few buckets have more than one; if these are too many to be
    sent, they are joined.
    """
    large = blocks.where("blocks > 1")
    large = F.broadcast(large) if large.count() <= _BROADCAST_ROWS else large
    rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return rows.drop("blocks", "other")


def _classified(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, set_a, set_b, class_id, n_links, n_copies, heads`` of every row.

    A node stands for one shingle set, as one id may have several. ``heads`` tells whether the row's id and
    shingle set stand for its class; ``digest`` is the text's.
    """
    all_rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    texts = all_rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    parts = parts_of(docs)
    described = materialize(map_arrow(texts, _describe, "doc_id long, digest long, set_a long, set_b long, n int, bands array<long>, sketch binary"), "jaccard-signatures")
    classes = described.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes", parts=parts)
    reps = described.join(classes.withColumnRenamed("rep", "doc_id"), ["set_a", "set_b", "doc_id"])
    keyed = reps.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    buckets = materialize(keyed.join(shared, "key").distinct(), "jaccard-buckets", parts=parts)
    nodes = reps.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"), *[F.any_value(x).alias(x) for x in ("n", "copies", "sketch")])
    nodes = materialize(nodes, "jaccard-nodes", parts=parts)
    cut = buckets.groupBy("key").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("blocks"))
    screen = map_arrow(_dealt(buckets, cut).join(nodes.select("node", "sketch"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), _screen(threshold, tolerance), "key long, band int, node long")
    left = materialize(screen.distinct(), "jaccard-left", buckets, parts=parts)
    sets = texts.join(nodes.join(left.select("node").distinct(), "node", "left_semi").select("doc_id", "digest", "node"), ["doc_id", "digest"]).select("node", "text")
    sets = materialize(map_arrow(sets, _prepare, "node long, shingles binary"), "jaccard-sets", parts=parts)
    left = left.join(nodes.select("node", "n", "copies", "sketch"), "node")
    cut = left.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    found = map_arrow(_dealt(left.drop("n"), cut).join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node"), _verify(threshold, tolerance), "node long, root long, links long")
    found = materialize(found, "jaccard-links", nodes, sets, parts=parts)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    merged = materialize(connected_components(found.where("node <> root"), "node", "root").join(classes.select("node", "set_a", "set_b", "rep"), "node"), "jaccard-merged", parts=parts)
    heads = merged.groupBy("component").agg(F.min(F.struct("rep", "set_a", "set_b")).alias("head"))
    merged = merged.join(heads, "component").select("node", F.col("head.rep").alias("least"), ((F.col("set_a") == F.col("head.set_a")) & (F.col("set_b") == F.col("head.set_b"))).alias("first"))
    results = classes.join(links, "node", "left").join(merged, "node", "left")
    results = results.select("set_a", "set_b", F.coalesce("least", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.coalesce("first", F.lit(True)).alias("first"))
    worded = described.select("doc_id", "digest", "set_a", "set_b").join(results, ["set_a", "set_b"]).withColumn("heads", F.col("first") & (F.col("doc_id") == F.col("class_id"))).drop("first")
    bare = all_rows.where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return worded.unionByName(bare.select("doc_id", "digest", F.col("digest").alias("set_a"), none.alias("set_b"), F.col("doc_id").alias("class_id"), none.alias("n_links"), one.alias("n_copies"), F.col("doc_id").isNotNull().alias("heads")))


def similarity_classes(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of every row.

    ``class_id`` is the smallest id that links lead to, ``n_links`` the number of other rows at or above
    the threshold (copies included), ``n_copies`` the number of rows with the same shingle set.
    """
    return _classified(docs, **settings).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Rows of ``docs`` that stand for their class; rows without id stay, repeated rows stay once.

    Unlike texts that share an id stand for classes of their own.
    """
    rows = _classified(docs, doc_id=doc_id, text=text, **settings)
    kept = rows.where("heads").groupBy(F.col("doc_id").alias("_class_head"), "set_a", "set_b").agg(F.min("digest").alias("_class_digest")).select("_class_head", "_class_digest")
    known = docs.withColumn("_digest", F.xxhash64(F.col(text))).join(kept, (F.col(doc_id) == F.col("_class_head")) & (F.col("_digest") == F.col("_class_digest")), "left_semi").dropDuplicates([doc_id, "_digest"]).drop("_digest")
    return known.unionByName(docs.where(F.col(doc_id).isNull()))
