"""Byte-level BPE encoding and decoding by recursive DuckDB queries in every partition.

Texts are cut into units before white space, and units into pieces by the tokenizer's pattern. Pieces that a
worker has not met before become rows of (piece, position, token), one per byte, in a DuckDB table. A recursive
query joins neighbouring rows with the merge table and contracts, in every piece, the leftmost pair of minimum
rank, until no piece has a pair left. Where the new token cannot take part in a merge of lower rank (``calm``),
further pairs of that rank are contracted in the same step, left to right: the next steps would do just that.
A piece that is a token as a whole is that token. Rows are keyed, so a step replaces them and the state stays
as long as the text.

Decoding cuts ids into runs that begin where a token begins with white space, and an ordered aggregation over
the (run, position, token) rows of new runs joins their bytes. Units, pieces and runs are remembered by 64-bit
hashes, up to a bound, after which the memory starts anew; two that share a hash would share their answer (odds
of 3e-8 in a memory of a million).

A cut before ASCII white space that follows another character than white space never changes the pieces: no
alternative of the pattern goes on from such a character into white space, and none looks back. Between two
bytes that no token has side by side no merge is possible, so pieces are cut there too.

Defined cases: null text is the empty text; the empty text has no ids; strings of special tokens are ordinary
text; equal texts have equal ids; rows without id and repeated rows are encoded like others; bytes
that are no UTF-8 count as U+FFFD; an empty table gives no rows; further columns are left out. A text's ids are one value, so a text ends at 2 GB of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm.textops import text_chunks, word_bounds, word_hashes
from foliant.shipping import map_arrow

#: Units, pieces and runs that a worker remembers, each.
MEMORY = 1_000_000
#: Bytes of text taken up together, bytes of new pieces in one query, ids of a run at most.
CHUNK, QUERY_BYTES, RUN_IDS = 2 << 20, 1 << 18, 64
#: Memory of a worker's DuckDB.
DUCKDB_MEMORY = "600MB"
_worker: dict = {}
#: UTF-8 of white space beyond ASCII, as numbers.
_WIDE_SPACE = np.array(sorted(int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_MERGES = """
CREATE TABLE merges AS
WITH cut AS (SELECT id, hex, unnest(range(2, length(hex), 2)) AS n FROM vocabulary),
split AS (SELECT cut.id, l.id AS left_id, r.id AS right_id FROM cut JOIN vocabulary l ON l.hex = substr(cut.hex, 1, n::INT) JOIN vocabulary r ON r.hex = substr(cut.hex, (n + 1)::INT)),
used AS (SELECT part, min(id) AS first FROM (SELECT left_id AS part, id FROM split UNION ALL SELECT right_id, id FROM split) GROUP BY part)
SELECT left_id, right_id, split.id AS rank, coalesce(first > split.id, true) AS calm FROM split LEFT JOIN used ON part = split.id
"""
# place: number of the piece above, position below 32 bits; a row without token has been contracted into the one before it
_ENCODE = """
WITH RECURSIVE state(place, id, step) USING KEY (place) AS (
  SELECT place, id, 0 FROM token
  UNION
  (WITH seen AS (SELECT place, id, step, lead(id) OVER w AS next_id, lead(place) OVER w AS next_place FROM state WHERE id IS NOT NULL WINDOW w AS (ORDER BY place)),
   pairs AS MATERIALIZED (
     SELECT place, place >> 32 AS word, seen.id, step, next_place, rank, calm
     FROM seen LEFT JOIN merges ON left_id = seen.id AND right_id = next_id AND next_place >> 32 = place >> 32),
   least AS MATERIALIZED (SELECT word, min(rank) AS rank FROM pairs WHERE rank IS NOT NULL GROUP BY word),
   hits AS (SELECT place, next_place, word, rank, calm FROM pairs JOIN least USING (word, rank)),
   marked AS (
     SELECT *, lag(next_place) OVER w IS DISTINCT FROM place AS opens, lag(word) OVER w IS DISTINCT FROM word AS leftmost, row_number() OVER w AS n
     FROM hits WINDOW w AS (ORDER BY place)),
   chains AS (SELECT *, max(CASE WHEN opens THEN n END) OVER (ORDER BY place) AS first FROM marked),
   chosen AS MATERIALIZED (SELECT place, next_place, rank FROM chains WHERE leftmost OR calm AND (n - first) % 2 = 0)
   SELECT pairs.place, CASE WHEN gone.next_place IS NULL THEN coalesce(kept.rank, pairs.id) END, step + 1
   FROM pairs SEMI JOIN least USING (word) LEFT JOIN chosen kept ON kept.place = pairs.place LEFT JOIN chosen gone ON gone.next_place = pairs.place))
SELECT place >> 32 AS word, id FROM state WHERE id IS NOT NULL ORDER BY place
"""
_DECODE = "SELECT run, string_agg(hex, '' ORDER BY position) AS hex FROM token JOIN vocabulary USING (id) GROUP BY run ORDER BY run"


class Remembered:
    """Runs of items in one pool, found by 64-bit hashes."""

    def __init__(self, kind: type, memory: int):
        self.kind, self.memory = kind, memory
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        """Which of some different hashes are not held. Makes room before new ones come."""
        if len(self.hashes) > self.memory:
            self.forget()
        return ~np.isin(hashes, self.hashes, assume_unique=True)

    def learn(self, hashes: np.ndarray, items: np.ndarray, sizes: np.ndarray) -> None:
        begins = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate((self.pool, items))
        merged = np.concatenate((self.hashes, hashes))
        order = np.argsort(merged, kind="stable")
        self.hashes, self.begins, self.sizes = merged[order], np.concatenate((self.begins, begins))[order], np.concatenate((self.sizes, sizes))[order]

    def gather(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of known hashes, one after the other, and where each hash's begin."""
        at = np.searchsorted(self.hashes, hashes)
        begins, sizes = self.begins[at], self.sizes[at]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return self.pool[np.arange(bounds[-1]) + np.repeat(begins - bounds[:-1], sizes)], bounds


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of some slices, one after the other."""
    sizes = ends - starts
    bounds = np.cumsum(sizes)
    return data[np.arange(bounds[-1] if len(bounds) else 0) + np.repeat(starts - (bounds - sizes), sizes)]


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of at most ``most`` together, or of one item."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin, and the end: at every document, and before ASCII white space after anything else but white space."""
    ends = word_bounds(data, offsets)[1]
    padded = np.concatenate((np.zeros(3, np.int64), data.astype(np.int64)))
    last, two, three = padded[ends + 2], padded[ends + 1], padded[ends]
    wide = np.isin(two << 8 | last, _WIDE_SPACE) | np.isin(three << 16 | two << 8 | last, _WIDE_SPACE)
    return np.unique(np.concatenate((offsets, ends[~wide])))


class BytePairs:
    """Encoding and decoding under ranks of byte strings, split by ``pattern`` first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.adjacent = np.zeros(1 << 16, dtype=bool)
        begins_run = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, i in ranks.items():
            one = np.frombuffer(token, np.uint8).astype(np.int64)
            self.adjacent[one[:-1] << 8 | one[1:]] = True
            begins_run[i] = token[:1].isspace()
        self.begins_run = begins_run
        self.units, self.pieces, self.runs = Remembered(np.int32, memory), Remembered(np.int32, memory), Remembered(np.uint8, memory)
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self._table("given", {"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.execute(_MERGES)

    def _table(self, name: str, columns: dict) -> None:
        self.con.register(name, pa.table(columns))

    def contract(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces between bounds, and how many each has: the recursive query."""
        splits = np.flatnonzero(~self.adjacent[data[:-1].astype(np.int64) << 8 | data[1:]]) + 1
        cuts = np.unique(np.concatenate((bounds, splits)))
        word = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        self._table("token", {"place": pa.array(word << 32 | (np.arange(len(data)) - cuts[:-1][word])), "id": pa.array(self.bytes_ids[data])})
        found = self.con.sql(_ENCODE).to_arrow_table()
        piece = np.searchsorted(bounds, cuts[:-1], side="right") - 1
        sizes = np.bincount(piece[found.column("word").to_numpy()], minlength=len(bounds) - 1)
        return found.column("id").to_numpy().astype(np.int32), sizes.astype(np.int64)

    def _learn_pieces(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of pieces of a buffer, all of them remembered afterwards."""
        data = np.frombuffer(raw, np.uint8)
        hashes = word_hashes(data, starts, ends)
        known, first = np.unique(hashes, return_index=True)
        new = first[self.pieces.unknown(known)]
        whole = np.array([self.ranks.get(raw[s:e], -1) for s, e in zip(starts[new].tolist(), ends[new].tolist())], dtype=np.int64)
        one, rest = new[whole >= 0], new[whole < 0]
        self.pieces.learn(hashes[one], whole[whole >= 0].astype(np.int32), np.ones(len(one), np.int64))
        for lo, hi in _portions(ends[rest] - starts[rest], QUERY_BYTES):
            part = rest[lo:hi]
            sizes = ends[part] - starts[part]
            ids, counts = self.contract(_slices(data, starts[part], ends[part]), np.concatenate(([0], np.cumsum(sizes))))
            self.pieces.learn(hashes[part], ids, counts)
        return hashes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a buffer's documents, and where each document's begin."""
        bounds = unit_bounds(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        unknown = self.units.unknown(hashes)
        new = first[unknown]
        if len(new):
            raw, pieces, counts = data.tobytes(), [], []
            for a, b in zip(starts[new].tolist(), ends[new].tolist()):
                found = self.pattern.findall(raw[a:b].decode("utf-8", "replace"))
                pieces += found
                counts.append(len(found))
            pieces = [p.encode() for p in pieces]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            ids, at = self.pieces.gather(self._learn_pieces(b"".join(pieces), np.cumsum(sizes) - sizes, np.cumsum(sizes)))
            self.units.learn(hashes[unknown], ids, np.diff(at[np.concatenate(([0], np.cumsum(counts)))]))
        ids, at = self.units.gather(hashes[which])
        return ids, at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of documents' ids, and where each document's begin."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
        opens = self.begins_run[ids]
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(opens)
        inside = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        starts = np.flatnonzero(inside % RUN_IDS == 0)
        ends = np.append(starts[1:], len(ids))
        raw = ids.astype("<u4").view(np.uint8)
        hashes, first, which = np.unique(word_hashes(raw, 4 * starts, 4 * ends), return_index=True, return_inverse=True)
        unknown = self.runs.unknown(hashes)
        new = first[unknown]
        if len(new):
            sizes = ends[new] - starts[new]
            run = np.repeat(np.arange(len(new)), sizes)
            self._table("token", {"run": pa.array(run), "position": pa.array(np.arange(len(run))), "id": pa.array(_slices(ids, starts[new], ends[new]), pa.int32())})
            texts = [bytes.fromhex(x) for x in self.con.sql(_DECODE).to_arrow_table().column("hex").to_pylist()]
            self.runs.learn(hashes[unknown], np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], dtype=np.int64))
        out, at = self.runs.gather(hashes[which])
        return out, at[np.searchsorted(starts, bounds)]

    def parts(self, data: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A buffer as it is, or a single long document in portions of whole units."""
        if len(offsets) > 2 or len(data) <= most:
            yield data, offsets
            return
        cuts = unit_bounds(data, offsets)
        for lo, hi in _portions(np.diff(cuts), most):
            part = data[cuts[lo] : cuts[hi]]
            yield part, np.array([0, len(part)])


def _coder(given: tuple[str, bytes, str]) -> BytePairs:
    """This worker's coder. The ranks come with the task, as executors need not have the file."""
    name, content, pattern = given
    if (name, pattern) not in _worker:
        _worker.clear()
        _worker[name, pattern] = BytePairs({base64.b64decode(t): int(i) for t, i in map(bytes.split, content.splitlines()) if t}, pattern)
    return _worker[name, pattern]


def _column(values: list[np.ndarray], bounds: list[np.ndarray]) -> pa.Array:
    """Binary values: the slices of each array between its bounds."""
    return pa.array([v[a:b].tobytes() for v, at in zip(values, bounds) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())


def _round_trip(shared, decoding: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), CHUNK):
                ids, texts = [], []
                for part, at in coder.parts(data, offsets):
                    found, edges = coder.encode(part, at)
                    ids.append((found.astype("<u4"), edges))
                    if decoding:
                        texts.append(coder.decode(found, edges))
                if len(ids) > 1:  # one long document
                    ids, texts = ([(np.concatenate([x for x, _ in each]), np.array([0, sum(len(x) for x, _ in each)]))] if each else [] for each in (ids, texts))
                columns = [batch.column(0).slice(lo, hi - lo), _column(*zip(*ids))] + ([_column(*zip(*texts))] if decoding else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(1)[row].as_py()
                ids = np.frombuffer(raw, "<u4").astype(np.int32) if raw else np.zeros(0, np.int32)
                out = coder.decode(ids, np.array([0, len(ids)]))[0].tobytes() if raw is not None else None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([out], pa.binary())], ["doc_id", "decoded"])

    return run


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return spark.sparkContext.broadcast((path, Path(path).read_bytes(), pattern or public_tokenizers.PATTERN))  # the vocabulary, whatever the input


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every text (little-endian unsigned 32-bit) and the bytes that they decode to."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _round_trip(_shared(docs.sparkSession, path, pattern), True), "doc_id long, ids binary, decoded binary")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _round_trip(_shared(docs.sparkSession, path, pattern), False), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded``: bytes of every row's ids; null for null."""
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return map_arrow(rows, _decode(_shared(encoded.sparkSession, path, None)), "doc_id long, decoded binary")
