"""Chunking, truncation and formatting of documents for models."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult

from foliant.functions import text as T
from foliant.shipping import ship, ship_to_driver

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> Iterator[str]:
    """Parts of a text, each but the first beginning with the separator."""
    if not separator:
        yield from text
        return
    begin, end = 0, text.find(separator)
    while end >= 0:
        if end > begin:
            yield text[begin:end]
        begin, end = end, text.find(separator, end + len(separator))
    if begin < len(text):
        yield text[begin:]


def _joined(pieces: Iterator[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces together as far as ``size`` allows, chunks sharing up to ``overlap``; only a chunk's pieces are held."""
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            # the next chunk begins with the earliest piece that keeps both bounds
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    yield "".join(held)


def text_chunks(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> Iterator[str]:
    """Stripped chunks of at most ``size`` characters, cut at the coarsest separator that serves, as they come."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    for short, run in groupby(_pieces(text, separators[at]), key=lambda piece: len(piece) < size):
        if short:
            yield from (c for c in (chunk.strip() for chunk in _joined(run, size, overlap)) if c)
        else:
            for piece in run:
                yield from text_chunks(piece, size, overlap, finer) if finer else [piece]


def split_text(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """All chunks of a text."""
    return list(text_chunks(text, size, overlap, separators))


class Chunks:
    """Table function: the chunks of a text, a row each, given on as they are cut."""

    @staticmethod
    def analyze(text, size, overlap, least_chars, most) -> AnalyzeResult:
        if overlap.value is not None and size.value is not None and overlap.value >= size.value:
            raise ValueError("the overlap must be smaller than the size")
        return AnalyzeResult(StructType([StructField("chunk_id", IntegerType()), StructField("chunk_len", IntegerType()), StructField("chunk_text", StringType())]))

    def eval(self, text, size, overlap, least_chars, most):
        if text:
            long_enough = (c for c in text_chunks(text, size, overlap) if len(c) >= least_chars)
            for i, chunk in enumerate(islice(long_enough, most or None)):
                yield i, len(chunk), chunk


def chunk_documents(docs: DataFrame, size: int, overlap: int = 0, least_chars: int = 0, first_chunks: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chunk_id, chunk_len, chunk_text``; ids are given after short chunks are dropped.

    A lateral join with ``Chunks``: no row holds all chunks of a document.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    ship_to_driver(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    chunks = F.udtf(Chunks)(F.col("_text").outer(), F.lit(size), F.lit(overlap), F.lit(least_chars), F.lit(first_chunks or 0))
    return rows.lateralJoin(chunks).select(F.col("_key").alias(key), "chunk_id", "chunk_len", "chunk_text")


def fixed_chunks(docs: DataFrame, size: int, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of equal width by position, with built-in functions alone."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(step))
    rows = docs.where(F.length(text) > 0).select(F.col(key), F.posexplode(F.transform(starts, lambda s: F.substring(F.col(text), s, F.lit(size)))).alias("chunk_id", "chunk_text"))
    return rows.select(key, "chunk_id", F.length("chunk_text").alias("chunk_len"), "chunk_text")


def truncated(docs: DataFrame, most: int, prompt_tokens: int = 0, output_tokens: int = 0, chat_tokens: int = 0, text: str = "context", strict: bool = False) -> DataFrame:
    """Context cut to the tokens that a prompt leaves, with ``num_truncated_tokens`` and ``truncated_ratio``."""
    budget = most - prompt_tokens - output_tokens - chat_tokens
    if strict and budget <= 0:
        raise ValueError("no tokens are left for the context")
    kept, cut, ratio = T.truncated_to_tokens(F.col(text), F.lit(budget))
    return docs.withColumns({text: kept, "num_truncated_tokens": cut, "truncated_ratio": ratio})


class Tokenizer(Protocol):
    """What a tokenizer must offer; it is built on the executors by a function without arguments."""

    def encode(self, text: str) -> list[int]: ...
    def decode(self, ids: list[int]) -> str: ...


def with_token_ids(docs: DataFrame, make: Callable[[], Tokenizer], text: str = "text", out: str = "ids", most: int | None = None) -> DataFrame:
    """Token ids of a text, the first ``most`` of them on request; null texts have none."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for part in parts:
            yield pd.Series([tokenizer.encode(t)[:most] if t else [] for t in part], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def token_counts(docs: DataFrame, make: Callable[[], Tokenizer], text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Numbers of tokens; a text's ids are dropped when they are counted."""
    ship(docs.sparkSession)

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for part in parts:
            yield pd.Series([len(tokenizer.encode(t)) if t else 0 for t in part], dtype="int32")

    return docs.withColumn(out, run(F.col(text)))


def truncated_by(docs: DataFrame, make: Callable[[], Tokenizer], budget: int, text: str = "context", strict: bool = False, counts: str | None = None) -> DataFrame:
    """As ``truncated``, in the tokens of a tokenizer; ``counts`` names a column for the tokens before the cut. Only one
    text's ids are held."""
    if strict and budget <= 0:
        raise ValueError("no tokens are left for the context")
    ship(docs.sparkSession)

    @F.pandas_udf("struct<kept:string,cut:int,n:int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = make()
        for part in parts:
            kept, sizes = [], []
            for t in part:
                ids = tokenizer.encode(t) if t else []
                sizes.append(len(ids))
                kept.append(t if len(ids) <= budget and t is not None else tokenizer.decode(ids[: max(budget, 0)]))
            yield pd.DataFrame({"kept": kept, "cut": [max(0, n - budget) for n in sizes], "n": sizes})

    cut = docs.withColumn("_c", run(F.col(text)))
    if counts is not None:
        cut = cut.withColumn(counts, F.col("_c.n"))
    has = F.lit(budget > 0)
    ratio = F.coalesce(F.try_divide("_c.cut", "_c.n"), F.lit(0.0))
    return cut.withColumns({text: F.when(has, F.col("_c.kept")).otherwise(""), "num_truncated_tokens": F.when(has, F.col("_c.cut")), "truncated_ratio": F.when(has, ratio)}).drop("_c")


def padded(docs: DataFrame, ids: str, width: int, pad: int = 0) -> DataFrame:
    """Token ids cut or filled up to one width, with the mask that tells them from padding."""
    kept = F.slice(ids, 1, width)
    missing = F.lit(width) - F.size(kept)
    filled = F.concat(kept, F.array_repeat(F.lit(pad), missing))
    mask = F.concat(F.transform(kept, lambda x: F.lit(1)), F.array_repeat(F.lit(0), missing))
    return docs.withColumns({"input_ids": filled, "attention_mask": mask}).drop(ids)


def messages(prompt: Column, output: Column | None = None) -> Column:
    """A user message, with the assistant's where an output is given."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", prompt), *([turn("assistant", output)] if output is not None else []))


def training_messages(docs: DataFrame, most: int, prompt: str = "prompt", context: str = "context", output: str = "output") -> DataFrame:
    """Messages with the answer for training: the context gives way to the tokens of its prompt and its answer."""
    used = F.size(T.tokens(F.col(prompt))) + F.size(T.tokens(F.col(output)))
    kept, cut, ratio = T.truncated_to_tokens(F.col(context), F.lit(most) - used)
    said = F.concat_ws(" ", F.col(prompt), F.nullif(kept, F.lit("")))
    return docs.withColumns({"messages": messages(said, F.col(output)), "num_truncated_tokens": cut, "truncated_ratio": ratio})


def with_attributes(chunks: DataFrame, docs: DataFrame, attributes: Sequence[str], key: str = "document_id") -> DataFrame:
    """Chunks with attributes of their documents; chunks without a document keep nulls."""
    return chunks.join(docs.select(key, *attributes), key, "left")


def chunk_summary(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: number of chunks, and least, most and mean of their lengths."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("chunk_len").alias("least"), F.max("chunk_len").alias("most"), F.round(F.avg("chunk_len"), 6).alias("mean"))


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed token counts by hash. No neural model."""
    hashes = F.transform(T.tokens(F.lower(text)), lambda t: F.xxhash64(t))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(dimensions)) == d), F.lit(0.0), lambda s, h: s + F.when(h < 0, -1.0).otherwise(1.0)).cast("float"))
