"""Ingestion with state for every document, retries by timers and counters from the running query.

A stream of documents is grouped by document. What is known of a document is a value in the state store, so a
micro-batch reads the state of its own documents and no tracker table. A document that is done is skipped. A
document that fails for good is a dead letter, with its error; when it arrives again it is tried again. A
document that fails for the moment keeps its text in the state and a timer, and is tried again when time has
passed the timer, up to a number of attempts, each waiting twice as long. Time is the watermark of the arrival
column, or of the batches' times where there is none, so it stands still while nothing arrives. Done documents can be forgotten after a while, and a row with the
reset column set makes the state forget its document at once.

Every call of the state costs a trip to the JVM. Where many documents arrive at once, ``shards`` lets the documents of a
hash share their state: it is read once and written once a batch for all of them, and has one timer, the next that is due.
A batch then reads and writes the state of the shards that it touches, and a task holds a shard's texts of one batch and
its texts that wait, so shards should be many. A checkpoint keeps the number that it began with.

The operator's output, attempts and chunks, goes to a file sink that writes every batch once, whatever is
replayed. Counters are observed on that output as it is written; a listener writes them down batch by batch.

Defined cases: rows without document id are left out; of a document that is repeated in a batch the longest text
counts; no text, or only white space, is an error; an empty stream writes nothing; attributes may have any name
but those of the output.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliant.functions.text import first_words
from foliant.shipping import ship_to_driver
from foliant.storage import setting

#: Of a text and the number of the attempt, from 1, its chunks.
Process = Callable[[str, int], list[str]]
OUTPUT = "kind string, document_id string, attempt int, success boolean, dead boolean, chunks_count int, error_message string, full_text string, chunk_id int, chunk_text string, at long"
PROGRESS = "run string, batch_id long, n_input long, n_attempts long, n_failed long, n_chunks long, n_retried long, state_rows long, state_updated long, state_reads long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The row that counts, whether to reset, and the latest time.
_NOTHING = (None, False, 0)


def _heard(told: tuple, row: Row) -> tuple:
    """What is told of a document, with one more row."""
    best, reset, now = told
    rank = lambda row: (len(row["full_text"] or ""), row["full_text"] or "", row["_now"])
    if row["_reset"]:
        reset = True
    elif best is None or rank(row) > rank(best):
        best = row
    return best, reset, max(now, row["_now"])


@dataclass(frozen=True)
class Retry:
    """How often a document is tried when it fails for the moment, and how long it waits at first."""

    attempts: int = 3
    wait_ms: int = 60_000
    transient: tuple[type[BaseException], ...] = (OSError, TimeoutError)

    def due(self, now: int, failed: int) -> int:
        return now + self.wait_ms * 2 ** (failed - 1)


class Documents(StatefulProcessor):
    """State of one document: how it stands, and its text while it waits for the next attempt."""

    def __init__(self, process: Process, retry: Retry, attributes: Sequence[str], kinds: StructType, keep_ms: int | None, least_chars: int):
        self.process, self.retry, self.attributes = process, retry, tuple(attributes)
        self.held = StructType([*StructType.fromDDL("full_text string, due long"), *kinds])
        self.row = Row(*StructType.fromDDL(OUTPUT).names, *attributes)
        self.keep_ms, self.least_chars = keep_ms, least_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stands = handle.getValueState("stands", "attempts int, success boolean, failed int, until long, at long")
        self.waiting = handle.getValueState("waiting", self.held)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._take_up(key, *reduce(_heard, rows, _NOTHING))

    def _take_up(self, key: tuple, best: Row | None, reset: bool, now: int) -> Iterator[Row]:
        attempts, success, failed, _, at = self.stands.get() or (0, False, 0, None, 0)
        now = max(now, at)  # a document's rows are in order of time
        if reset and attempts:
            if failed:
                self._drop_waiting()
                failed = 0
            success = False
            self.stands.update((attempts, False, 0, None, now))
            yield self._row(key, None, kind="reset", attempt=attempts, at=now)
        if best is not None and not success:
            if failed:  # only a document that failed can wait; every look at the state costs a call
                self._drop_waiting()
            yield from self._attempt(key, best["full_text"], [best[a] for a in self.attributes], attempts, 0, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, known = expiredTimerInfo.getExpiryTimeInMs(), self.stands.get()
        held = self.waiting.get()
        if held is not None and held[1] == due:
            self.waiting.clear()
            yield from self._attempt(key, held[0], list(held[2:]), known[0], known[2], due)
        elif known is not None and known[1] and known[3] == due:
            self.stands.clear()  # forgotten

    def close(self) -> None:
        pass

    def _drop_waiting(self) -> None:
        held = self.waiting.get()
        if held is not None:
            self.handle.deleteTimer(held[1])
            self.waiting.clear()

    def _attempt(self, key: tuple, text: str | None, attributes: list, attempts: int, failed: int, now: int) -> Iterator[Row]:
        attempt = attempts + 1
        try:
            if text is None or not text.strip():
                raise ValueError("no text")
            chunks = [c for c in self.process(text, attempt) if len(c) >= self.least_chars]
        except Exception as problem:  # one document must not stop a batch
            failed += 1
            again = isinstance(problem, self.retry.transient) and failed < self.retry.attempts
            if again:
                due = self.retry.due(now, failed)
                self.waiting.update((text, due, *attributes))
                self.handle.registerTimer(due)
            self.stands.update((attempt, False, failed, None, now))
            yield self._row(key, attributes, kind="attempt", attempt=attempt, success=False, dead=not again, chunks_count=0, error_message=str(problem) or type(problem).__name__, at=now)
            return
        until = now + self.keep_ms if self.keep_ms is not None else None
        if until is not None:
            self.handle.registerTimer(until)
        self.stands.update((attempt, True, failed, until, now))
        yield self._row(key, attributes, kind="attempt", attempt=attempt, success=True, dead=False, chunks_count=len(chunks), full_text=text, at=now)
        for i, chunk in enumerate(chunks):
            yield self._row(key, attributes, kind="chunk", attempt=attempt, chunk_id=i, chunk_text=chunk, at=now)

    def _row(self, key: tuple, attributes: list | None, **values) -> Row:
        told = {"document_id": key[0], **values, **dict(zip(self.attributes, attributes or ()))}
        return self.row(*[told.get(name) for name in self.row])


class _Held:
    """The values of a shard's documents while it is worked on; ``key`` is the document whose turn it is."""

    def __init__(self, values: dict):
        self.values, self.key, self.changed = values, None, False

    def get(self) -> tuple | None:
        return self.values.get(self.key)

    def update(self, value: tuple) -> None:
        self.values[self.key], self.changed = value, True

    def clear(self) -> None:
        self.values.pop(self.key, None)
        self.changed = True


class _OneTimer:
    """A shard finds its next timer in what it holds, so its documents register none."""

    def registerTimer(self, due: int) -> None:
        pass

    def deleteTimer(self, due: int) -> None:
        pass


class Shards(Documents):
    """State of the documents of a shard: a value for how they stand, and one for the texts of those that wait.

    Rows go out as arrays by column, about ``packed_chars`` characters of text at a time (``unpacked``).
    """

    packed_chars = 1 << 20

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shard, self.handle = handle, _OneTimer()
        self.known = handle.getValueState("known", "timer long, document_ids array<string>, attempts array<int>, success array<boolean>, failed array<int>, until array<long>, at array<long>")
        self.texts = handle.getValueState("texts", StructType([StructField("rows", ArrayType(StructType([StructField("document_id", StringType()), *self.held])))]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = {}
        for row in rows:
            told[row["document_id"]] = _heard(told.get(row["document_id"], _NOTHING), row)
        timer = self._load()
        yield from self._packed(self._at(document, self._take_up((document,), *heard)) for document, heard in told.items())
        self._store(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, timer = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        self.stands.changed = True  # Spark drops the timer
        timer, passed = None if timer == passed else timer, max(passed, timerValues.getCurrentWatermarkInMs())
        again = super().handleExpiredTimer
        yield from self._packed(self._at(document, again((document,), timerValues, ExpiredTimerInfo(due))) for due, document in sorted(d for d in self._due() if d[0] <= passed))
        self._store(timer)

    def _at(self, document: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        self.stands.key = self.waiting.key = document
        yield from rows

    def _row(self, key: tuple, attributes: list | None, **values) -> tuple:
        told = {"document_id": key[0], **values, **dict(zip(self.attributes, attributes or ()))}
        return tuple(told.get(name) for name in self.row)

    def _packed(self, rows: Iterator[Iterator[tuple]]) -> Iterator[Row]:
        held, chars, texts = [], 0, [self.row.index(name) for name in ("full_text", "chunk_text")]
        for row in chain.from_iterable(rows):
            held.append(row)
            chars += 100 + sum(len(row[at] or "") for at in texts)
            if chars > self.packed_chars:
                yield self.row(*map(list, zip(*held)))
                held, chars = [], 0
        if held:
            yield self.row(*map(list, zip(*held)))

    def _load(self) -> int | None:
        timer, names, *stands = self.known.get() or (None, (), (), (), (), (), ())
        self.stands = _Held(dict(zip(names, zip(*stands))))
        held = self.texts.get() if any(failed and not success for success, failed in zip(stands[1], stands[2])) else None
        self.waiting = _Held({row[0]: tuple(row[1:]) for row in held[0]} if held else {})
        return timer

    def _due(self) -> Iterator[tuple[int, str]]:
        yield from ((held[1], document) for document, held in self.waiting.values.items())
        yield from ((stands[3], document) for document, stands in self.stands.values.items() if stands[3] is not None)

    def _store(self, timer: int | None) -> None:
        if self.stands.changed:  # nothing waits for a change without a new stand
            due = min(self._due(), default=(None,))[0]
            if due != timer and timer is not None:
                self.shard.deleteTimer(timer)
            if due != timer and due is not None:
                self.shard.registerTimer(due)
            stands = list(zip(*self.stands.values.values())) or [()] * 5
            self.known.update((due, list(self.stands.values), *map(list, stands)))
        if self.waiting.changed:
            self.texts.update(([(document, *held) for document, held in self.waiting.values.items()],))


class ProgressLog(StreamingQueryListener):
    """Writes what was observed of a query, a small file for each batch, so that a replayed batch is told once."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder, name
        self.run, self.ended, self.error = None, threading.Event(), None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if told.name != self.name or "ingested" not in told.observedMetrics:
            return
        try:
            seen = told.observedMetrics["ingested"].asDict()
            state = told.stateOperators[0] if told.stateOperators else None
            row = {"run": str(told.id), "batch_id": told.batchId, "n_input": told.numInputRows, **{k: v or 0 for k, v in seen.items()}}
            if state is not None:
                row |= {"state_rows": state.numRowsTotal, "state_updated": state.numRowsUpdated, "state_reads": dict(state.customMetrics).get("rocksdbGetCount")}
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-{told.batchId:012d}.json")
            out = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(path, True)
            out.write((json.dumps(row) + "\n").encode())
            out.close()
        except Exception as problem:  # a listener's error would only be logged
            self.error = problem

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()


def attempts_of(stream: DataFrame, key: str, text: str, process: Process, retry: Retry | None = None, attributes: Sequence[str] = (), arrived: str | None = None, late: str = "0 seconds", keep_ms: int | None = None, reset: str | None = None, least_chars: int = 0, shards: int | None = None) -> DataFrame:
    """Attempts and chunks of a stream of documents (``OUTPUT`` and the attributes), kept apart by ``kind``.

    Each document has a state of its own, or shares that of its shard.
    """
    ship_to_driver(stream.sparkSession)
    kinds = StructType([stream.schema[a] for a in attributes])
    rows = stream.where(F.col(key).isNotNull()).withColumn("_arrived", (F.col(arrived) if arrived else F.current_timestamp()).cast("timestamp")).withWatermark("_arrived", late)
    forget = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    rows = rows.select(F.col(key).cast("string").alias("document_id"), F.col(text).alias("full_text"), F.coalesce(F.unix_millis("_arrived"), F.lit(0)).alias("_now"), forget.alias("_reset"), "_arrived", *attributes)
    told, options = StructType([*StructType.fromDDL(OUTPUT), *kinds]), (process, retry or Retry(), attributes, kinds, keep_ms, least_chars)
    if not shards:
        return rows.groupBy("document_id").transformWithState(Documents(*options), told, "Append", "EventTime")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("document_id"), F.lit(shards)))
    packed = rows.groupBy("_shard").transformWithState(Shards(*options), StructType([StructField(f.name, ArrayType(f.dataType)) for f in told]), "Append", "EventTime")
    return unpacked(packed)


def unpacked(packed: DataFrame) -> DataFrame:
    """The rows of arrays of one length, by column."""
    return packed.select(F.inline(F.arrays_zip(*[F.col(f"`{name}`") for name in packed.columns])))


def counted(output: DataFrame) -> DataFrame:
    """The same rows; what passes is counted on the way."""
    attempt = F.col("kind") == "attempt"
    return output.observe("ingested", F.count_if(attempt).alias("n_attempts"), F.count_if(attempt & ~F.col("success")).alias("n_failed"), F.count_if(F.col("kind") == "chunk").alias("n_chunks"), F.count_if(attempt & (F.col("attempt") > 1)).alias("n_retried"))


def ingest_keyed(stream: DataFrame, target: str, checkpoint: str, key: str, text: str, process: Process, **options) -> None:
    """Take up all that has arrived since the checkpoint, then stop. ``options`` as in ``attempts_of``."""
    spark = stream.sparkSession
    name = f"ingest {target}"
    log = ProgressLog(spark, f"{target}/progress", name)
    spark.streams.addListener(log)
    try:
        with setting(spark, _PROVIDER, _ROCKSDB):
            output = counted(attempts_of(stream, key, text, process, **options))
            query = output.writeStream.queryName(name).format("parquet").partitionBy("kind").outputMode("append").option("checkpointLocation", checkpoint).option("path", f"{target}/output").trigger(availableNow=True).start()
            query.awaitTermination()
        log.ended.wait(60)
    finally:
        spark.streams.removeListener(log)
    if log.error is not None:
        raise log.error


def output(spark: SparkSession, target: str, schema: StructType | str = OUTPUT) -> DataFrame:
    """All that was written; nothing yet is an empty table."""
    try:
        return spark.read.schema(schema).parquet(f"{target}/output")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def keyed_tracker(spark: SparkSession, target: str) -> DataFrame:
    """How every document stands after its last attempt; documents that were reset since are left out."""
    rows, when = output(spark, target).where("kind in ('attempt', 'reset')"), F.struct("at", "attempt")
    attempt = F.col("kind") == "attempt"
    last = F.max_by(F.when(attempt, F.struct("at", "attempt", "success", "dead", "chunks_count", "error_message")), F.when(attempt, when))
    stands = rows.groupBy("document_id").agg(last.alias("last"), F.count_if(attempt).alias("n_attempts"), F.max(F.when(~attempt, when)).alias("reset"))
    stands = stands.where(F.col("reset").isNull() | (F.struct("last.at", "last.attempt") > F.col("reset")))
    return stands.select("document_id", "n_attempts", "last.success", "last.dead", "last.chunks_count", "last.error_message")


def keyed_dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """Documents that failed for good, with the kind of their error."""
    return keyed_tracker(spark, target).where("dead").select("document_id", "n_attempts", "error_message", first_words(F.col("error_message")).alias("kind"))


def keyed_progress(spark: SparkSession, target: str) -> DataFrame:
    """The counters of every batch, as they were observed while it was written."""
    return spark.read.schema(PROGRESS).json(f"{target}/progress")


def by_split(split: Callable[[str], list[str]]) -> Process:
    """A splitter that does not care which attempt it is."""
    return partial(_split, split)


def _split(split: Callable[[str], list[str]], text: str, attempt: int) -> list[str]:
    return split(text)
