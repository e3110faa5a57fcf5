"""The pipeline's stages against plain versions."""

import corpus_pipeline as C
import plain
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = C.toxicity(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    one = C.ngram_jaccard(spark, kept, SF)
    heads = sorted(i for i, c, _ in plain.similarity_classes(rows) if i == c)
    assert sorted(r.doc_id for r in one.collect()) == heads and one.columns == docs.columns
    left = {i: t for i, t in rows if i in set(heads)}
    cut = {r.doc_id: r for r in C.substring_dedup(spark, one, SF).collect()}
    wanted = {i: (n, gone) for (i, n, gone, _) in plain.removed_words(list(left.items()))}
    assert set(cut) == {i for i, (n, gone) in wanted.items() if not n or gone < n}
    for i, r in cut.items():
        assert len(plain.words(r.text)) == wanted[i][0] - wanted[i][1] and r.n_chars == len(r.text)
        assert wanted[i][1] or r.text == left[i]
    mixed = C.mixing(spark, one, SF)
    assert mixed.columns == docs.columns
    size = one.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] - 1.5 * size) < 40


def test_run(spark):
    pieces = C.run(spark, SF)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_awkward_documents(spark, docs, nothing):
    frame, empty = docs, nothing
    for name, stage in C.STAGES:
        frame = stage(spark, frame, SF)
        empty = stage(spark, empty, SF)
        assert frame.count() > 0 and empty.count() == 0, name
        if name != "packing":
            assert frame.columns == docs.columns
