"""Toxicity by a convolutional text classifier.

A word is the mean of three hashed embeddings: of itself and of its first four and five letters, after
lower-casing and without signs around it. Filters over one, two and three words, each pooled by its
maximum over the whole text, feed a logistic output. The network is trained in numpy on all labelled
documents. These are dealt by hash to shards, each packed once as a row of word features. In a round every
shard goes on from the common network, one document a step, and the mean of what the shards have learned,
parameter by parameter over those that touched it, is the next common network; a pass over one shard comes
first, so that all others go on from the same beginning. A fifth of the documents, which is not trained on,
sets the output's offset and a threshold per language, from counts by margin. Embeddings that training never
touched are zero, so unknown words are silent. The driver holds the network and those counts.

Scoring projects every distinct word of a buffer once per filter position and adds what the words of a
window contribute; each text is scored whole, in one pass over the documents without a shuffle.

Defined cases: null or empty text gets the score of a text without words; rows without label, unlabelled
ids and repeated rows are scored like others; a language without a threshold uses one half; without
labels of both kinds every score is 0; an empty table gives no rows; further columns are carried along.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.textops import text_chunks, word_bounds, word_hashes
from foliant.shipping import map_arrow, ship
from foliant.storage import discard, materialize

BUCKETS, WIDTH, FILTERS, SIZES = 1 << 15, 12, 8, (1, 2, 3)
#: Labelled documents of a shard, and labels that are broadcast to find their documents.
SHARD_DOCUMENTS, MOST_SENT = 1024, 1 << 20
#: Passes over all shards: two, and up to six where they make fewer steps than this.
LEAST_PASSES, MOST_PASSES, STEPS = 2, 6, 1 << 16
#: Blocks of embeddings that are averaged together.
BLOCKS = 16
BLOCK_ROWS = BUCKETS // BLOCKS
#: Grid of the margins among which cuts are chosen.
STEP, MOST_STEPS = 1 / 256, 1 << 14
#: Result columns; columns of these names in the input give way.
ADDED = ("toxicity_score", "toxicity_flag")
_SIGNS = string.punctuation + "«»„“”‘’¿¡…–—"


def word_features(word: str) -> tuple[int, int, int]:
    """Buckets of a word and of its first letters."""
    word = word.lower().strip(_SIGNS)
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS, zlib.crc32(b"4" + word[:4].encode("utf-8", "replace")) % BUCKETS, zlib.crc32(b"5" + word[:5].encode("utf-8", "replace")) % BUCKETS


@dataclass
class Network:
    embedding: np.ndarray  # buckets x width
    filters: list[np.ndarray]  # per size: positions x width x filters
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float
    scale: float = 1.0

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (pooled @ self.out + self.offset), -40, 40)))


def _buffer(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a buffer's distinct words, which of them each word is, and where documents begin."""
    starts, ends, at = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), at
    _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    features = np.array([word_features(raw[s:e].decode("utf-8", "replace")) for s, e in zip(starts[first].tolist(), ends[first].tolist())], dtype=np.int64)
    return features, which, at


def pool(net: Network, features: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pooled filter values of each document of a buffer."""
    n_docs, total = len(at) - 1, sum(len(b) for b in net.biases)
    pooled = np.zeros((n_docs, total), dtype=np.float64)
    filled = np.flatnonzero(np.diff(at))
    if not len(filled):
        return pooled
    words = net.embedding[features].mean(axis=1)
    last = np.repeat(at[1:], np.diff(at))  # end of each word's document
    column = 0
    for weights, bias in zip(net.filters, net.biases):
        value = None
        for s in range(len(weights)):
            part = np.vstack((words @ weights[s], np.zeros((1, weights.shape[2]), dtype=words.dtype)))
            here = np.full(len(which), len(words))  # beyond the document: nothing
            if s:
                inside = np.arange(len(which) - s) + s < last[: len(which) - s]
                here[: len(which) - s][inside] = which[s:][inside]
            else:
                here = which
            value = part[here] if value is None else value + part[here]
        best = np.maximum.reduceat(value, at[:-1][filled], axis=0) + bias
        pooled[filled, column : column + len(bias)] = np.maximum(best, 0)
        column += len(bias)
    return pooled


class Learner:
    """The network's parameters and their Adagrad sums, as they are trained."""

    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        filters = [rng.normal(0, 0.3, (size, WIDTH, FILTERS)).astype(np.float32) for size in SIZES]
        biases = [np.zeros(FILTERS, np.float32) for _ in SIZES]
        self.dense = [*filters, *biases, rng.normal(0, 0.3, FILTERS * len(SIZES)).astype(np.float32), np.zeros(1, np.float32)]
        self.embedding_sums = np.full_like(self.embedding, 1e-2)
        self.dense_sums = [np.full_like(x, 1e-2) for x in self.dense]

    def copy(self) -> Learner:
        other = Learner.__new__(Learner)
        other.embedding, other.embedding_sums = self.embedding.copy(), self.embedding_sums.copy()
        other.dense, other.dense_sums = [x.copy() for x in self.dense], [x.copy() for x in self.dense_sums]
        return other

    def blocks(self, touched: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Numbers of rows and the rows, with their sums, of the touched embeddings by block, and of all else as one row."""
        for block in range(BLOCKS):
            rows = np.flatnonzero(touched[block * BLOCK_ROWS : (block + 1) * BLOCK_ROWS]) + block * BLOCK_ROWS
            if len(rows):
                yield block, rows, np.hstack((self.embedding[rows], self.embedding_sums[rows]))
        yield BLOCKS, np.zeros(1, np.int64), np.concatenate([x.ravel() for x in (*self.dense, *self.dense_sums)])[None, :]

    def take(self, block: int, rows: np.ndarray, values: np.ndarray) -> None:
        """Set what ``blocks`` gives."""
        if block < BLOCKS:
            self.embedding[rows], self.embedding_sums[rows] = values[:, :WIDTH], values[:, WIDTH:]
            return
        at = 0
        for x in (*self.dense, *self.dense_sums):
            x.ravel()[:] = values[0, at : at + x.size]
            at += x.size

    def network(self, touched: np.ndarray) -> Network:
        """Embeddings that training never touched are zero."""
        n = len(SIZES)
        return Network(np.where(touched[:, None], self.embedding, np.float32(0)), self.dense[:n], self.dense[n : 2 * n], self.dense[2 * n].astype(np.float64), float(self.dense[-1][0]))

    def epoch(self, documents: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, rate: float, seed: int) -> None:
        """One pass by Adagrad, one document (features of its distinct words, which of them each word is) a step."""
        n_sizes = len(SIZES)
        embedding, sums = self.embedding, self.embedding_sums
        filters, biases, out, offset = self.dense[:n_sizes], self.dense[n_sizes : 2 * n_sizes], self.dense[-2], self.dense[-1]
        filter_sums, bias_sums, out_sums, offset_sums = self.dense_sums[:n_sizes], self.dense_sums[n_sizes : 2 * n_sizes], self.dense_sums[-2], self.dense_sums[-1]
        for d in np.random.Generator(np.random.PCG64(seed)).permutation(len(documents)):
            features, which = documents[d]
            n = len(which)
            if not n:
                continue
            vectors = embedding[features].mean(axis=1)
            pooled, places, column = np.zeros(len(out), np.float32), [], 0
            for weights, bias in zip(filters, biases):
                size = len(weights)
                value = np.zeros((n, FILTERS), np.float32)
                for s in range(min(size, n)):
                    value[: n - s] += (vectors @ weights[s])[which[s:]]
                place = value.argmax(axis=0)
                best = value[place, np.arange(FILTERS)] + bias
                pooled[column : column + FILTERS] = np.maximum(best, 0)
                places.append((place, best > 0))
                column += FILTERS
            p = 1 / (1 + np.exp(-np.clip(pooled @ out + offset[0], -40, 40)))
            error = np.float32((p - labels[d]) * weight[d])
            upward = error * out
            grad_out = error * pooled
            out_sums += grad_out**2
            offset_sums += error**2
            column = 0
            for f, (weights, bias) in enumerate(zip(filters, biases)):
                place, active = places[f]
                g = upward[column : column + FILTERS] * active
                column += FILTERS
                grad_w = np.zeros_like(weights)
                for s in range(len(weights)):
                    ok = np.flatnonzero((place + s < n) & (g != 0))
                    if not len(ok):
                        continue
                    words = which[place[ok] + s]
                    grad_w[s][:, ok] = vectors[words].T * g[ok]
                    back = (weights[s][:, ok] * g[ok]).T / 3
                    rows = features[words].ravel()
                    back = np.repeat(back, 3, axis=0)
                    np.add.at(sums, rows, back**2)
                    np.add.at(embedding, rows, -rate * back / np.sqrt(sums[rows]))
                filter_sums[f] += grad_w**2
                weights -= rate * grad_w / np.sqrt(filter_sums[f])
                bias_sums[f] += g**2
                bias -= rate * g / np.sqrt(bias_sums[f])
            out -= rate * grad_out / np.sqrt(out_sums)
            offset -= rate * error / np.sqrt(offset_sums)


def pool_texts(net: Network, texts: list[str]) -> np.ndarray:
    out = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
        out.append(pool(net, *_buffer(data, offsets)))
    return np.concatenate(out) if out else np.zeros((0, len(net.out)))


def best_cut(scores: np.ndarray, toxic: np.ndarray, clean: np.ndarray, weight_clean: float) -> float | None:
    """Middle of the widest best cut by weighted F1, from how many documents of each kind have a score; None without both kinds."""
    if not toxic.any() or not clean.any():
        return None
    order = np.argsort(-scores, kind="stable")
    s, hit, wrong = scores[order], np.cumsum(toxic[order]), np.cumsum(clean[order]) * weight_clean
    f1 = 2 * hit / (hit + wrong + toxic.sum())
    real = np.append(s[1:] != s[:-1], True)
    f1 = np.where(real, f1, -1)
    at = int(f1.argmax())
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else s[at])) / 2)


_SHARD = "_shard int, n long, toxic binary, aside binary, langs array<string>, words binary, distinct binary, features binary, at binary"


def _packed(group: pa.Table) -> pa.Table:
    """A shard as one row: of every document its kind and its distinct words' features, and which of them each word is."""
    group = group.sort_by([("_order", "ascending"), ("_id", "ascending")])
    features, words, counts = [np.zeros((0, 3), np.uint16)], [np.zeros(0, np.int32)], []
    known: dict[str, tuple[int, int, int]] = {}
    for _, _, data, offsets in text_chunks(group.column("_text")):
        starts, ends, at = word_bounds(data, offsets)
        hashes, raw = word_hashes(data, starts, ends), data.tobytes()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            _, first, which = np.unique(hashes[a:b], return_index=True, return_inverse=True)
            own = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b][first].tolist(), ends[a:b][first].tolist())]
            if len(known) > 1 << 18:
                known.clear()
            for word in own:
                if word not in known:
                    known[word] = word_features(word)
            features.append(np.array([known[w] for w in own], dtype=np.uint16).reshape(-1, 3))
            words.append(which.astype(np.int32).ravel())
            counts.append((b - a, len(own)))
    toxic, aside = group.column("_toxic").to_numpy().astype(np.uint8), np.array(group.column("_aside").to_pylist(), np.uint8)
    sizes = np.array(counts, dtype=np.int64).reshape(-1, 2)
    row = (group.column("_shard")[0].as_py(), group.num_rows, toxic.tobytes(), aside.tobytes(), group.column("_lang").to_pylist(), np.concatenate(words).tobytes(), sizes[:, 1].tobytes(), np.concatenate(features).tobytes(), sizes[:, 0].tobytes())
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([value], kind) for value, kind in zip(row, kinds)], names=["_shard", "n", "toxic", "aside", "langs", "words", "distinct", "features", "at"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list, list[tuple[np.ndarray, np.ndarray]]]]:
    """Shards: number, kinds, which documents are put aside, languages, documents."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
            words, features = get("words", np.int32), get("features", np.uint16).reshape(-1, 3)
            w, f = (np.concatenate(([0], np.cumsum(get(name, np.int64)))).tolist() for name in ("at", "distinct"))
            documents = [(features[f[d] : f[d + 1]].astype(np.int64), words[w[d] : w[d + 1]]) for d in range(len(w) - 1)]
            yield batch.column("_shard")[row].as_py(), get("toxic", np.uint8), get("aside", np.uint8) == 1, batch.column("langs")[row].as_py(), documents


def _round(shared, only: int | None, use_aside: bool, weights: tuple[float, float], rate: float, seed: int):
    """What every shard has learned in a pass from what is known, by blocks of parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, toxic, aside, _, documents in _unpacked(batches):
            mine = np.flatnonzero(~aside | use_aside)
            if not len(mine) or only not in (None, shard):
                continue
            learner, touched, kept = shared.value.copy(), np.zeros(BUCKETS, dtype=bool), [documents[i] for i in mine]
            for features, _ in kept:
                touched[features.ravel()] = True
            learner.epoch(kept, toxic[mine], np.where(toxic[mine] == 1, weights[1], weights[0]), rate, seed + shard)
            for block, rows, values in learner.blocks(touched):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([rows.astype(np.int32).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["block", "shard", "rows", "values"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of every row over the shards that have touched it, block by block, in the order of the shards."""

    def told():
        rows = np.flatnonzero(seen)
        mean = (total[rows] / seen[rows, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rows.astype(np.int32).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["block", "rows", "values"])

    block = None
    for batch in batches:
        for row in range(batch.num_rows):
            here = batch.column("block")[row].as_py()
            rows = np.frombuffer(batch.column("rows")[row].as_buffer(), np.int32)
            values = np.frombuffer(batch.column("values")[row].as_buffer(), np.float32).reshape(len(rows), -1)
            if here != block:
                if block is not None:
                    yield told()
                block, total, seen = here, np.zeros((BUCKETS if here < BLOCKS else 1, values.shape[1])), np.zeros(BUCKETS if here < BLOCKS else 1, np.int64)
            total[rows] += values
            seen[rows] += 1
    if block is not None:
        yield told()


def _margins(shared, use_aside: bool):
    """Numbers of held documents by language, kind and margin, in steps of ``STEP``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for _, toxic, aside, langs, documents in _unpacked(batches):
            held = np.flatnonzero(aside if use_aside else ~aside).tolist()
            found = []
            for d in held:
                features, which = documents[d]
                found.append(pool(net, features, which, np.array([0, len(which)]))[0] @ net.out + net.offset)
            steps = np.clip(np.rint(np.array(found) / STEP), -MOST_STEPS, MOST_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in held], pa.string()), pa.array(toxic[held].astype(np.int32)), pa.array(steps)], ["lang", "toxic", "step"])

    return run


def _weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values)
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_toxic: int | None = None, most_clean: int | None = None) -> tuple[Network | None, dict[str, float]]:
    """Network and thresholds by language, from all labelled rows whose crc32(id) mod 5 is not 0.

    With ``most_toxic`` or ``most_clean``, from the documents with the smallest hashes alone. Of rows that share an id
    the smallest text counts.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None, {}
    n_labels = sum(counts.values())
    if most_toxic is not None or most_clean is not None:
        limits = {1: counts[1] if most_toxic is None else most_toxic, 0: counts[0] if most_clean is None else most_clean}
        chosen = [known.where(F.col("_toxic") == kind).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most) for kind, most in limits.items()]
        known, n_labels = chosen[0].unionByName(chosen[1]), min(n_labels, sum(limits.values()))
    shards = 1 + n_labels // SHARD_DOCUMENTS
    name = F.col(doc_id).cast("string")
    rows = docs.where(F.crc32(name) % 5 != 0).select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(lang).alias("_lang"))
    rows = rows.join(F.broadcast(known) if n_labels <= MOST_SENT else known, "_id")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")).repartition(shards, "_shard")
    rows = rows.groupBy("_shard", "_id", "_toxic").agg(F.min(F.struct("_text", "_lang")).alias("_row")).select("_shard", "_id", "_toxic", "_row.*")
    rows = rows.withColumns({"_order": F.md5(F.col("_id").cast("string")), "_aside": F.crc32(F.concat(F.col("_id").cast("string"), F.lit("#aside"))) % 5 == 0})
    ship(spark)
    packed = materialize(rows.groupBy("_shard").applyInArrow(_packed, _SHARD), "toxicity-shards")
    kinds = packed.select("_shard", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), "toxic", "aside")
    byte = lambda c: F.conv(F.hex(F.substring(c, F.col("i"), F.lit(1))), 16, 10).cast("int")
    kinds = {(r["t"], r["a"]): r["n"] for r in kinds.groupBy(byte(F.col("toxic")).alias("t"), byte(F.col("aside")).alias("a")).agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [kinds.get((t, 0), 0) + kinds.get((t, 1), 0) for t in (0, 1)]
    if not min(totals):
        discard(packed)
        return None, {}
    put_aside = min(kinds.get((t, a), 0) for t in (0, 1) for a in (0, 1)) >= 3
    trained = [kinds.get((t, 0), 0) + (0 if put_aside else kinds.get((t, 1), 0)) for t in (0, 1)]
    weights = tuple(0.5 / max(1, n) * sum(trained) for n in trained)
    learner, touched = Learner(), np.zeros(BUCKETS, dtype=bool)
    first = packed.agg(F.min("_shard")).first()[0]
    passes = min(MOST_PASSES, max(LEAST_PASSES, -(-STEPS // sum(trained))))
    # a pass over one shard, so that all others go on from the same beginning; then passes over all
    for turn, only in enumerate((first, *[None] * passes)):
        shared = spark.sparkContext.broadcast(learner)
        told = map_arrow(packed if only is None else packed.where(F.col("_shard") == only), _round(shared, only, not put_aside, weights, 0.1 * 0.9**turn, (turn << 20) + 5), "block int, shard int, rows binary, values binary")
        mean = map_arrow(told.repartition(1 + BLOCKS, "block").sortWithinPartitions("block", "shard"), _averaged, "block int, rows binary, values binary")
        for r in mean.collect():  # as large as the network
            rows_of = np.frombuffer(r["rows"], np.int32)
            learner.take(r["block"], rows_of, np.frombuffer(r["values"], np.float32).reshape(len(rows_of), -1))
            if r["block"] < BLOCKS:
                touched[rows_of] = True
        shared.destroy()
    net = learner.network(touched)
    shared = spark.sparkContext.broadcast(net)
    found = map_arrow(packed, _margins(shared, put_aside), "lang string, toxic int, step int").groupBy("lang", "step").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    found = found.toPandas().sort_values(["lang", "step"])  # at most 2 * MOST_STEPS + 1 steps a language
    shared.destroy()
    discard(packed)
    margin, toxic, clean = found["step"].to_numpy() * STEP, found["toxic"].to_numpy(), found["clean"].to_numpy()
    weight_clean = (counts[0] / totals[0]) / (counts[1] / totals[1])
    by_step = found.groupby("step")[["toxic", "clean"]].sum()
    cut = best_cut(by_step.index.to_numpy() * STEP, by_step["toxic"].to_numpy(), by_step["clean"].to_numpy(), weight_clean)
    if cut is not None:
        net.offset -= cut
        margin = margin - cut
    spread = _weighted_median(np.abs(margin), toxic + clean)
    net.scale = float(2.0 / spread) if spread > 0 else 1.0
    scores, thresholds = 1 / (1 + np.exp(-np.clip(net.scale * margin, -40, 40))), {}
    for name in sorted(found["lang"].dropna().unique()):
        mine = (found["lang"] == name).to_numpy()
        own = best_cut(scores[mine], toxic[mine], clean[mine], weight_clean)
        wrong = lambda t: (toxic[mine] * (scores[mine] < t) + clean[mine] * (scores[mine] >= t)).sum()  # noqa: B023, E731
        if own is not None and toxic[mine].sum() >= 5 and wrong(own) < wrong(0.5):
            thresholds[name] = min(0.9, max(0.1, own))
    return net, thresholds


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("_toxicity_text")
            rest = batch.select([x for x in batch.schema.names if x != "_toxicity_text"])
            for lo, hi, data, offsets in text_chunks(batch.column(at)):
                scores = net.score(pool(net, *_buffer(data, offsets)))
                part = rest.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, "toxicity_score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, **settings) -> DataFrame:
    """Columns ``keep`` (all of ``docs``, if none are named) with ``toxicity_score`` and ``toxicity_flag``
    (at or above the threshold of the row's language)."""
    net, thresholds = fit(docs, labels, doc_id, text, lang, **settings)
    keep = [c for c in keep or docs.columns if c not in ADDED]
    rows = docs.drop(*ADDED).select(*keep, F.col(text).alias("_toxicity_text"), *([] if lang in keep else [F.col(lang)]))
    if net is None:
        scored = rows.drop("_toxicity_text").withColumn("toxicity_score", F.lit(0.0))
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_toxicity_text") + ", toxicity_score double"
        scored = map_arrow(rows, _score(docs.sparkSession.sparkContext.broadcast(net)), schema)
    threshold = F.lit(0.5)
    for name, value in sorted(thresholds.items()):
        threshold = F.when(F.col(lang) == name, F.lit(value)).otherwise(threshold)
    return scored.withColumn("toxicity_flag", F.col("toxicity_score") >= threshold).select(*keep, "toxicity_score", "toxicity_flag")


def reject_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` below the threshold of their language."""
    return score_documents(docs, labels, **settings).where(~F.col("toxicity_flag")).select(*docs.columns)
