"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word is removed when a window that covers
it also starts in a document with a smaller id; windows are judged on the input.

1. Documents are gathered in groups of bounded size by a hash of id and text. A group lists the 64-bit
   hashes of its windows once each, with the smallest and largest id that holds it, packed by ranges of
   hashes. A range finds the windows that occur in two documents, and their first document, and
   answers every group that holds them. A window in a third of all documents is one entry a group.
2. Groups read their documents again. Runs of recurring windows in their first document are the
   repeated passages; runs in later documents are spans to be searched.
3. Passages are dealt to shards by their document. A shard compiles the windows of its passages into
   Aho-Corasick automata over word codes and streams the spans that name it through them, so that every
   occurrence is confirmed word by word. A shard that very much text names is opened several times, with
   a part of the spans each.
4. Located runs of windows go back to their documents and become removed spans.

A document is read only by the automata that its hashes name, so work grows with the input. A window
is lost only if its hash is that of another one (odds of 5e-7 a window among 1e13).

Defined cases: null or empty texts have no words and stay empty; a row without id is kept whole and
removes nothing from others; rows with one id never remove words from each other; repeated rows get
equal results; an empty table gives no rows; further columns are carried along,
but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.textops import pack_longs, ragged, rolling, run_starts, scramble, sorted_groups, text_chunks, unpack_longs, word_bounds, word_hashes
from foliant.shipping import map_arrow, ship
from foliant.storage import materialize, parts_for

WINDOW = 13
#: Bytes of text of a group of documents, and bytes of text whose windows share a range of hashes.
GROUP_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
#: Windows of a row sent between groups and ranges.
ROW_WINDOWS = 1 << 13
#: Bytes of the whole table for each shard of passages, and bytes of spans that one opening of a shard reads.
SHARD_BYTES, STREAM_BYTES = 1 << 20, 2 << 20
#: Bytes that a span counts for besides its text.
SPAN_BYTES = 256
#: Windows of one row of a passage or span, and of one automaton.
PIECE_WINDOWS, AUTOMATON_WINDOWS = 4096, 1 << 16
#: Bytes of text for one file of an intermediate table and one part of the result.
PART_BYTES = 32 << 20
#: Rows of the table of shards to be opened several times up to which it is broadcast.
_BROADCAST_ROWS = 200_000
_U = np.uint64
_SPANS = "kind int, shard long, doc_id long, mark long, start int, size int, text string"


def _windows_of(data: np.ndarray, offsets: np.ndarray, window: int):
    """Word bounds, where documents begin in them, and of each window its first word, document row and hash."""
    starts, ends, at = word_bounds(data, offsets)
    place, rows = run_starts(at, window)
    runs = rolling(word_hashes(data, starts, ends), window)
    return starts, ends, at, place, rows, runs[place] if len(place) else np.zeros(0, _U)


def _merged(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order with the smallest and largest of their ids."""
    if not len(hashes):
        return hashes, first, last
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    cuts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[cuts], np.minimum.reduceat(first[order], cuts), np.maximum.reduceat(last[order], cuts)


def _list_windows(window: int, bits: int):
    """Of each group its distinct windows, by ranges of hashes."""

    def rows(group: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes, first, last = _merged(*(np.concatenate(x) for x in zip(*parts)))
        ranges = (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True])))
        cuts = np.union1d(cuts, np.arange(0, len(ranges), ROW_WINDOWS))
        for i in range(0, len(cuts) - 1, 8):
            part = [(a, b) for a, b in zip(cuts[i : i + 9][:-1], cuts[i : i + 9][1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(ranges[[a for a, _ in part]]), pa.array([group] * len(part), pa.int64()),
                *(pa.array([pack_longs(x[a:b]) for a, b in part], pa.binary()) for x in (hashes, first, last - first)),
            ], ["range", "group", "hashes", "first", "spread"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            groups, ids = batch.column("group").to_numpy(), batch.column("doc_id").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True]))) if len(groups) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if groups[a] != group:
                    if parts:
                        yield from rows(group, parts)
                    group, parts = int(groups[a]), []
                for lo, _, data, offsets in text_chunks(batch.column("text").slice(a, b - a)):
                    *_, at, hashes = _windows_of(data, offsets, window)
                    if len(hashes):
                        doc = ids[a + lo + at]
                        parts.append(_merged(hashes, doc, doc))
        if parts:
            yield from rows(group, parts)

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range and group the windows that start in two documents of the corpus, and the smallest id they start in."""
    for table in sorted_groups(batches, ["range"], 1, 1):
        hashes, first, spread = ([unpack_longs(x.as_buffer()) for x in table.column(name)] for name in ("hashes", "first", "spread"))
        counts = [len(x) for x in hashes]
        flat = np.concatenate(hashes).view(_U)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        low, high = np.concatenate(first), np.concatenate(spread)
        high += low
        low, high = np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts)
        sizes = np.diff(np.append(cuts, len(ordered)))
        smallest, wanted = np.empty(len(flat), np.int64), np.empty(len(flat), bool)
        smallest[order], wanted[order] = np.repeat(low, sizes), np.repeat(low < high, sizes)
        ends = np.cumsum(counts)
        out: list[tuple] = []
        for group, a, b in zip(table.column("group").to_pylist(), ends - counts, ends):
            keep = wanted[a:b]
            if keep.any():
                out.append((group, pack_longs(flat[a:b][keep]), pack_longs(smallest[a:b][keep])))
            if len(out) == 16 or out and b == len(flat):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["group", "hashes", "first"])
                out = []


def _spans(window: int, shards: int, piece: int):
    """Passages (kind 1) and spans to be searched (kind 0) of a group's documents."""
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("text", pa.string())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not texts.num_rows:
            return schema.empty_table()
        known = np.concatenate([unpack_longs(x.as_buffer()) for x in answers.column("hashes")]).view(_U)
        smallest = np.concatenate([unpack_longs(x.as_buffer()) for x in answers.column("first")])
        order = np.argsort(known)
        known, smallest = known[order], smallest[order]
        ids, marks = texts.column("doc_id").to_numpy(), texts.column("mark").to_numpy()
        out: list[tuple] = []
        for lo, _, data, offsets in text_chunks(texts.column("text")):
            starts, ends, begins, place, rows, hashes = _windows_of(data, offsets, window)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            first, doc = smallest[at], ids[lo + rows]
            kind = np.where(known[at] == hashes, np.where(first < doc, 0, 1), -1)
            shard = (scramble(first.view(_U)) % _U(shards)).astype(np.int64)
            shard[kind < 0] = -1
            edges = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (kind[1:] != kind[:-1]) | (shard[1:] != shard[:-1]), [True])))
            raw = data.tobytes()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if kind[a] < 0:
                    continue
                row = rows[a]
                for s in range(a, b, piece):
                    e = min(b, s + piece)
                    first_byte, end = starts[place[s]], ends[place[e - 1] + window - 1]
                    out.append((kind[a], shard[a], doc[a], marks[lo + row], place[s] - begins[row], end - first_byte, raw[first_byte:end]))
        columns = list(zip(*out)) if out else [()] * len(schema)
        return pa.Table.from_arrays([pa.array(np.array(c, dtype=np.int64)).cast(f.type) if f.name != "text" else pa.array(c, pa.binary()).cast(pa.string()) for c, f in zip(columns, schema)], schema=schema)

    return run


def phrase_automaton(passages: list[list[bytes]], values: list[int], window: int) -> tuple[ahocorasick.Automaton | None, dict[bytes, int]]:
    """An automaton of all windows of the passages over word codes, and the code of each word; 0 is any other word."""
    codes: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, value in zip(passages, values):
        coded = tuple([codes.setdefault(w, len(codes) + 1) for w in words])
        for i in range(len(coded) - window + 1):
            automaton.add_word(coded[i : i + window], value)
    if not len(automaton):
        return None, codes
    automaton.make_automaton()
    return automaton, codes


def _locate(window: int, most_windows: int):
    """Of each span the runs of windows that its shard's automata find and that start in a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["shard", "salt"], 1, 1):
            kinds = table.column("kind").to_numpy()
            at, sources = np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 1)
            if not len(at) or not len(sources):
                continue
            ids, texts = table.column("doc_id").to_numpy(), table.column("text").cast(pa.binary())
            spans = [texts[int(i)].as_py().split() for i in at]
            hits: list[list[int]] = [[] for _ in spans]
            held, values, size = [], [], 0
            for n, i in enumerate(sources.tolist(), 1):
                held.append(texts[i].as_py().split())
                values.append(int(ids[i]))
                size += len(held[-1]) - window + 1
                if size < most_windows and n < len(sources):
                    continue
                automaton, codes = phrase_automaton(held, values, window)
                held, values, size = [], [], 0
                if automaton is None:
                    continue
                for k, words in enumerate(spans):
                    own = ids[at[k]]
                    hits[k] += [end - window + 1 for end, first in automaton.iter(tuple([codes.get(w, 0) for w in words])) if first < own]
                del automaton
            keep, lengths, begin, stop = [], [], [], []
            starts = table.column("start").to_numpy()
            for k, found in enumerate(hits):
                if found:
                    where = np.unique(np.array(found)) + starts[at[k]]
                    cuts = np.flatnonzero(np.diff(where) != 1)
                    begin.append(where[np.concatenate(([0], cuts + 1))])
                    stop.append(where[np.concatenate((cuts, [len(where) - 1]))] + 1)
                    keep.append(at[k])
                    lengths.append(len(cuts) + 1)
            if keep:
                marks = table.column("mark").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(marks[keep]), ragged(np.concatenate(begin).astype(np.int32), lengths, pa.int32()), ragged(np.concatenate(stop).astype(np.int32), lengths, pa.int32())], ["doc_id", "mark", "begin", "stop"])

    return run


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def repeated_windows(docs: DataFrame, size: int, window: int = WINDOW, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES, shard_bytes: int = SHARD_BYTES, stream_bytes: int = STREAM_BYTES, automaton_windows: int = AUTOMATON_WINDOWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, begin, stop``: runs of windows that also start in a document with a smaller id.

    ``size`` is the number of bytes of all texts. ``mark`` is a hash of the text, for rows that share an id; a run's windows start at the words
    ``begin`` to ``stop`` - 1. Rows without such windows are absent.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    parts = parts_for(docs.sparkSession, size, PART_BYTES)
    groups, shards = 1 + size // group_bytes, 1 + size // shard_bytes
    bits = (size // range_bytes).bit_length()
    # two passes over the texts: the windows' shuffles are gone before the second one
    grouped = texts.select(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(groups)).alias("group"), "doc_id", "mark", "text").repartition("group")
    listed = map_arrow(grouped.sortWithinPartitions("group"), _list_windows(window, bits), "range long, group long, hashes binary, first binary, spread binary")
    answers = map_arrow(listed.repartition("range").sortWithinPartitions("range"), _recurring, "group long, hashes binary, first binary")
    answers = materialize(answers, "substring-answers", parts=parts)
    spans = materialize(grouped.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(_spans(window, shards, PIECE_WINDOWS), _SPANS), "substring-spans", answers, parts=parts)
    searched = spans.where("kind = 0").groupBy("shard").agg(F.ceil(F.sum(F.col("size") + SPAN_BYTES) / stream_bytes).alias("openings"))
    crowded = searched.where("openings > 1")
    many = F.broadcast(crowded) if crowded.count() <= _BROADCAST_ROWS else crowded
    dealt = spans.join(many, "shard", "left").withColumn("openings", F.coalesce("openings", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("doc_id", "mark", "start"), F.col("openings")))
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("kind") == 0, own).otherwise(F.sequence(F.lit(0), F.col("openings") - 1)))).drop("openings")
    located = map_arrow(dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt"), _locate(window, automaton_windows), "doc_id long, mark long, begin array<int>, stop array<int>")
    return located.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("begin")).alias("begin"), F.flatten(F.collect_list("stop")).alias("stop"))  # spans of one text


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begins, stops = batch.column("_repeat_text"), batch.column("_repeat_begin"), batch.column("_repeat_stop")
            kept, n_words, n_removed, spans = [], [], [], []
            for text, begin, stop in zip(texts, begins, stops):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n, bits = len(words), None
                if begin.is_valid and len(begin):
                    steps = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(steps, begin.values.to_numpy(zero_copy_only=False), 1)
                    np.add.at(steps, stop.values.to_numpy(zero_copy_only=False) + window - 1, -1)
                    bits = np.cumsum(steps[:-1]) > 0
                n_words.append(n)
                if bits is None:
                    kept.append(b" ".join(words))
                    n_removed.append(0)
                    spans.append([])
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate(([0], bits.view(np.int8), [0]))))
                spans.append([{"start": int(s), "words": int(e - s)} for s, e in edges.reshape(-1, 2)])
                n_removed.append(int(bits.sum()))
                kept.append(b" ".join([w for w, gone in zip(words, bits.tolist()) if not gone]))
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if not name.startswith("_repeat_")]
            yield pa.RecordBatch.from_arrays([
                *rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string()),
            ], [*(x for x in batch.schema.names if not x.startswith("_repeat_")), "repeat_n_words", "repeat_n_removed", "repeat_spans", "repeat_kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Every row of ``docs`` with ``repeat_n_words``, ``repeat_n_removed``, ``repeat_spans`` (removed runs
    of words) and ``repeat_kept_text`` (words that stay, joined by one space)."""
    docs = docs.drop("repeat_n_words", "repeat_n_removed", "repeat_spans", "repeat_kept_text")
    size = text_bytes(docs, text)
    found = repeated_windows(docs, size, window, doc_id=doc_id, text=text, **settings)
    found = found.select(F.col("doc_id").alias("_repeat_id"), F.col("mark").alias("_repeat_mark"), F.col("begin").alias("_repeat_begin"), F.col("stop").alias("_repeat_stop"))
    columns = docs.columns
    rows = docs.join(found, (F.col(doc_id).cast("long") == F.col("_repeat_id")) & (F.xxhash64(F.col(text)) == F.col("_repeat_mark")), "left")
    rows = rows.select(*columns, F.col(text).alias("_repeat_text"), "_repeat_begin", "_repeat_stop")
    rows = rows.coalesce(parts_for(docs.sparkSession, size, PART_BYTES))  # small tables give few files
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", repeat_n_words long, repeat_n_removed long, repeat_spans array<struct<start:int,words:int>>, repeat_kept_text string"
    return map_arrow(rows, _cut(window), schema)
