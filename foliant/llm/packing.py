"""Packing along a space-filling curve.

Documents are tokenised once. The tokens of a document, hashed to 1024 features and normalised, are
projected to three dimensions; the Hilbert key of that point orders the documents, ranges of the order
that hold about as many ids each become partitions, and each partition is packed in order, documents cut
where a sequence is full. Neighbours on the curve share sequences. A cell of the curve that holds more
than a partition, such as many copies, is dealt to several by hash. What is left at the end of a partition is cut into
sequences of powers of two, which need no padding.

Where the tokenizer's file says that words between white space are tokenised by themselves (it lower-cases,
splits by a pattern that holds no white space, and knows bytes), they are tokenised once per worker and
remembered. A word of plain Latin letters, digits and signs is split by the file's pattern and goes to the
merges of the vocabulary directly, any other through the whole tokenizer; both give the tokenizer's ids.
With any other file whole texts go through the tokenizer.

Defined cases: null or empty text is the end id alone; equal keys are ordered by id, so copies are
spread over partitions; repeated rows and rows without id are packed like others; an empty table gives
no rows; further columns are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from foliant.llm.textops import text_chunks, word_bounds, word_hashes
from foliant.shipping import map_arrow
from foliant.storage import materialize

LENGTH = 4096
END_ID = 2
FEATURES, DIMENSIONS, BITS = 1024, 3, 12
#: Ids of a partition of the curve, and of a row; longer documents have several rows.
PARTITION_IDS, ROW_IDS = 8_000_000, 32_768
#: Bits of a curve key that name its cell; ids are counted by cell.
CELL_BITS = 18
#: Words that a worker remembers, by their hashes.
MEMORY = 600_000
_SIMPLE = regex.compile(r"[\x21-\x7EÀ-ÖØ-öø-įı-ſ]+")
_worker: dict = {}


def splitting_rule(path: str) -> regex.Pattern | None:
    """The pattern of pieces of a tokenizer whose words between white space don't touch each other, or None."""
    stated = json.loads(Path(path).read_text())
    normalizers = [x["type"] for x in (stated.get("normalizer") or {}).get("normalizers", [])]
    steps = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normalizers != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or stated.get("post_processor"):
        return None
    split, level = steps
    apart = stated["normalizer"]["normalizers"][1] | {"type": ""} == {"type": "", "pattern": {"Regex": r"\s+"}, "content": " "}
    if not apart or split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    found = regex.compile(split["pattern"]["Regex"])
    return None if found.search(" ") else found


class WordTokenizer:
    """Ids of words under a ``tokenizers`` file, remembered up to ``memory`` words."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.whole, self.memory = Tokenizer.from_file(path), memory
        self.rule = splitting_rule(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.merges = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.forget()
        self.pieces: dict[str, bytes] = {}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # byte-level alphabet

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = np.array([t.id for t in self.merges.tokenize(shown)], dtype="<u2").tobytes()
            if len(self.pieces) >= self.memory:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def forget(self) -> None:
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, dtype="<u2")

    def word(self, word: bytes) -> bytes:
        """Little-endian 16-bit ids of a word without white space."""
        text = word.decode("utf-8", "replace")
        if _SIMPLE.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join([self.piece(p) for p in self.rule.findall(text.lower())])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Keep the ids of new words under their ascending hashes."""
        each = [self.word(w) for w in words]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 2
        begins = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(each), dtype="<u2")))
        merged = np.concatenate((self.hashes, hashes))
        order = np.argsort(merged, kind="stable")  # two sorted runs
        self.hashes, self.begins, self.sizes = merged[order], np.concatenate((self.begins, begins))[order], np.concatenate((self.sizes, sizes))[order]

    def places(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of words begin, and how many they are; hashes ascend."""
        if len(self.hashes) > self.memory:
            self.forget()
        new = ~np.isin(hashes, self.hashes, assume_unique=True)
        if new.any():
            self.learn(hashes[new], [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
        at = np.searchsorted(self.hashes, hashes)
        return self.begins[at], self.sizes[at]


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _worker:
        _worker[path] = WordTokenizer(path)
    return _worker[path]


def token_ids(data: np.ndarray, offsets: np.ndarray, tokenizer: WordTokenizer) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a buffer's documents, and where each document's begin."""
    if tokenizer.rule is None:
        raw = data.tobytes()
        each = [tokenizer.whole.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate([np.array(x, dtype=np.uint16) for x in each]), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
    starts, ends, at = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    hashes, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    begins, sizes = tokenizer.places(hashes, data.tobytes(), starts[first], ends[first])
    counts = sizes[which]
    ends_at = np.cumsum(counts)
    index = np.arange(ends_at[-1]) + np.repeat(begins[which] - (ends_at - counts), counts)
    return tokenizer.pool[index], np.concatenate(([0], ends_at))[at]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations of each level, from the coarsest
        low = bit - 1
        for i in range(dims):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, 0) ^ swap
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's hashed, normalised and projected token counts."""
    n = len(bounds) - 1
    feature = ((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)  # 10 bits
    keys = np.zeros(n, dtype=np.int64)
    projection = np.random.Generator(np.random.PCG64(11)).standard_normal((FEATURES, DIMENSIONS))
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        rows = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
        counts = np.bincount(rows * FEATURES + feature[bounds[lo] : bounds[hi]], minlength=(hi - lo) * FEATURES).reshape(hi - lo, FEATURES).astype(np.float64)
        counts = np.sqrt(counts)
        norm = np.linalg.norm(counts, axis=1, keepdims=True)
        point = (counts / np.where(norm == 0, 1, norm)) @ projection
        spread = 1 / (1 + np.exp(-1.702 * point))  # close to the normal distribution's
        keys[lo:hi] = hilbert_keys(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
    return keys


def _tokenise(path: str, end_id: int, row_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = word_tokenizer(path), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            docs = batch.column(0)
            for lo, hi, data, offsets in text_chunks(batch.column(1), 4 << 20):
                ids, bounds = token_ids(data, offsets, tokenizer)
                raw, keys = ids.astype("<u2").tobytes(), curve_keys(ids, bounds)
                sizes = np.diff(bounds) + 1
                rows = -(-sizes // row_ids)
                which = np.repeat(np.arange(hi - lo), rows)
                starts = (np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)) * row_ids
                parts = []
                for doc, at in zip(which.tolist(), starts.tolist()):
                    a, b = bounds[doc] + at, min(bounds[doc] + at + row_ids, bounds[doc + 1])
                    parts.append(raw[2 * a : 2 * b] + (end if at + row_ids >= sizes[doc] else b""))
                for k in range(0, len(which), 2048):
                    part = which[k : k + 2048]
                    yield pa.RecordBatch.from_arrays([
                        docs.take(pa.array(lo + part)), pa.array(keys[part]), pa.array(sizes[part]), pa.array(starts[k : k + 2048]),
                        pa.array([len(x) // 2 for x in parts[k : k + 2048]], pa.int32()), pa.array(parts[k : k + 2048], pa.binary()),
                    ], ["doc_id", "key", "n", "start", "size", "ids"])

    return run


def ranges(cells: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell, in ascending order, its first partition and how many of its own it is dealt to."""
    first, own, used, filled = [], [], 0, 0
    for size in ids.tolist():
        if size > most:
            used += filled > 0
            first.append(used)
            own.append(-(-size // most))
            used, filled = used + own[-1], 0
            continue
        if filled + size > most:
            used, filled = used + 1, 0
        first.append(used)
        own.append(1)
        filled += size
    return np.array(first, dtype=np.int64), np.array(own, dtype=np.int64)


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        open_pieces: list[tuple] = []  # doc_id, start, ids, doc_tokens
        filled = 0

        def close(pieces: list[tuple], size: int, sequence: int, out: list[tuple]) -> int:
            """Write pieces as one full sequence or, at the end, as sequences of powers of two."""
            at, i, used = 0, 0, 0
            for bit in [size] if size == length else [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]:
                at = 0
                while at < bit:
                    doc, start, ids, tokens = pieces[i]
                    take = min(bit - at, len(ids) - used)
                    out.append((doc, start + used, take, ids[used : used + take].astype("<u4").tobytes(), tokens, sequence, at))
                    at, used = at + take, used + take
                    if used == len(ids):
                        i, used = i + 1, 0
                sequence += 1
            return sequence

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            out: list[tuple] = []
            for doc, begin, tokens, raw in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "start", "n")), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2")
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    open_pieces.append((doc, begin + at, ids[at : at + take], tokens))
                    filled, at = filled + take, at + take
                    if filled == length:
                        sequence = close(open_pieces, filled, sequence, out)
                        open_pieces, filled = [], 0
                if len(out) >= 2000:
                    yield table(out)
                    out = []
            open_pieces = [(d, s, np.array(i), t) for d, s, i, t in open_pieces]  # lets the batch go
            if out:
                yield table(out)
        if open_pieces:
            out = []
            close(open_pieces, filled, sequence, out)
            yield table(out)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, partition_ids: int = PARTITION_IDS, row_ids: int = ROW_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit),
    ``doc_tokens, sequence_id, offset``."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = materialize(map_arrow(rows, _tokenise(path, end_id, row_ids), "doc_id long, key long, n long, start long, size int, ids binary"), "packing-ids")
    cell = F.shiftright("key", DIMENSIONS * BITS - CELL_BITS)
    counts = tokens.groupBy(cell.alias("cell")).agg(F.sum("size").alias("ids")).toPandas().sort_values("cell")  # at most 2**CELL_BITS rows
    first, own = ranges(counts["cell"].to_numpy(), counts["ids"].to_numpy(), partition_ids)
    places = docs.sparkSession.createDataFrame(pa.table({"cell": pa.array(counts["cell"].to_numpy(), pa.int64()), "first": pa.array(first), "own": pa.array(own)}))
    dealt = tokens.withColumn("cell", cell).join(F.broadcast(places), "cell")
    dealt = dealt.withColumn("slot", (F.col("first") + F.pmod(F.xxhash64("doc_id", "n", "start"), F.col("own"))).cast("int"))
    ordered = dealt.repartitionById(int((first + own).max()) if len(first) else 1, "slot").sortWithinPartitions("key", "doc_id", "n", "start")
    return map_arrow(ordered.select("doc_id", "start", "n", "ids"), _pack(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
