"""Queries of the text operators that run in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm.byte_pairs import round_trip
from foliant.llm.jaccard_join import similarity_classes
from foliant.llm.neighbours import nearest
from foliant.llm.packing import pack
from foliant.llm.substring_dedup import remove_repeats
from foliant.llm.text_oracles import OP1_SQL, OP8_SQL
from foliant.llm.token_counts import count_tokens
from foliant.llm.toxicity import score_documents
from foliant.llm.url_filter import judge_urls
from foliant.sources import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("repeat_n_words").alias("n_words"), F.col("repeat_n_removed").alias("n_removed"), F.sha2("repeat_kept_text", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    predicted = F.when(F.col("toxicity_score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity_score").alias("score"), predicted.alias("predicted"), F.col("toxicity_flag").alias("flagged"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, OP1_SQL),
    "op4_url_filter": (op4_url_filter, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_neighbours": (op6_neighbours, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_jaccard_join": (op8_jaccard_join, OP8_SQL),
    "op9_packing": (op9_packing, None),
    "op11_byte_bpe": (op11_byte_bpe, None),
}
