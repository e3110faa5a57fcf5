"""Incremental ingestion of folders of documents, over the keyed state of ``streaming.keyed``.

A file stream is taken up in micro-batches; what is known of a document is in the state store. A document that
fails, for want of text or in its chunking, fails by itself, with its error in the tracker, and does not stop the
stream. Attempts and chunks are written once, whatever is replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from foliant.operators.chunking import hashed_embedding, split_text
from foliant.operators.validation import IngestSettings
from foliant.sinks import chunk_objects
from foliant.streaming import keyed


def tracker(spark: SparkSession, target: str) -> DataFrame:
    """How each document stands: ``document_id, success, chunks_count, error_message, dead, n_attempts``."""
    return keyed.keyed_tracker(spark, target)


def tracker_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("chunks"))


def without_matching(rows: DataFrame, pattern: str) -> DataFrame:
    """Tracker rows but those whose document id contains the pattern (``%`` and ``_`` are wild, any case)."""
    return rows.where(~F.col("document_id").ilike(f"%{pattern}%"))


def chunks(spark: SparkSession, target: str, attributes: str = "") -> DataFrame:
    """Chunks of all documents that were taken up, as objects of a store, with the named attributes (as DDL)."""
    rows = keyed.output(spark, target, keyed.OUTPUT + (f", {attributes}" if attributes else "")).where("kind = 'chunk'")
    names = rows.columns[len(StructType.fromDDL(keyed.OUTPUT).names) :]
    rows = rows.select("document_id", "chunk_id", F.length("chunk_text").alias("chunk_len"), "chunk_text", *names)
    return chunk_objects(rows).withColumn("vector", hashed_embedding(F.col("chunk_text")))


def documents(spark: SparkSession, target: str, attributes: str = "") -> DataFrame:
    """Documents that were taken up, with the text and attributes of their last success."""
    rows = keyed.output(spark, target, keyed.OUTPUT + (f", {attributes}" if attributes else "")).where("kind = 'attempt' and success")
    names = rows.columns[len(StructType.fromDDL(keyed.OUTPUT).names) :]
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("full_text", *names), F.struct("at", "attempt")).alias("_row"))
    return last.select("document_id", "_row.*")


def progress(spark: SparkSession, target: str) -> DataFrame:
    """``batch_id, n_documents, n_failed, n_chunks`` of every batch, as counted while it was written."""
    return keyed.keyed_progress(spark, target).select("batch_id", F.col("n_attempts").alias("n_documents"), "n_failed", "n_chunks", "n_input", "state_reads")


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """Documents that failed for good, by kind of error."""
    return keyed.keyed_dead_letters(spark, target)


def ingest(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, settings: IngestSettings | None = None, key: str = "document_id", text: str = "full_text", files_per_batch: int = 100, attributes: Sequence[str] = (), split: Callable[[str], list[str]] | None = None, **options) -> None:
    """Take up all files that arrived since the checkpoint, then stop. ``options`` as in ``keyed.attempts_of``."""
    settings = settings or IngestSettings()
    cut = split or partial(split_text, size=settings.chunk_size, overlap=settings.overlap)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    keyed.ingest_keyed(stream, target, checkpoint, key, text, keyed.by_split(cut), attributes=attributes, least_chars=settings.least_chars, **options)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time counts in tumbling windows with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
