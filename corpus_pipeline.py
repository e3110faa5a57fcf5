"""A corpus from raw documents to packed sequences.

Five stages, each on all that the one before it kept: toxic documents go, one document of each group
of near duplicates stays, words of recurring passages go after their first document, sources are mixed
to their target weights, and what is left is packed.

All stages but the last return the columns of their input. A document without a word left after the
third stage is dropped. Where there is a column ``n_chars`` it follows the text.

Defined cases: null and empty texts have no words; the first stage scores them like any text without words,
the next two keep them and mixing takes nothing of them. Repeated rows stay once from the second stage on; rows
without id are linked to nothing and kept whole by the third. Empty tables stay empty; further columns are
carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm.jaccard_join import keep_one_per_class
from foliant.llm.mixing import mixture_rows
from foliant.llm.packing import pack
from foliant.llm.substring_dedup import remove_repeats
from foliant.llm.toxicity import reject_toxic
from foliant.sources import table
from foliant.storage import materialize


def _with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents at or above the toxicity threshold of their language."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by a similarity of 0.8 or more."""
    return keep_one_per_class(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that recur from an earlier document."""
    cut = remove_repeats(docs)
    text = F.when(F.col("repeat_n_removed") > 0, F.col("repeat_kept_text")).otherwise(F.col("text"))
    left = cut.where((F.col("repeat_n_words") == 0) | (F.col("repeat_n_removed") < F.col("repeat_n_words")))
    return _with_lengths(left.withColumn("text", text)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per pass over a document, in the order of the curriculum."""
    return _with_lengths(mixture_rows(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: The stages are no SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to shared storage and read again, and its input goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", docs)
    return STAGES[-1][1](spark, docs, sf_dir)
