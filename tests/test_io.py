"""Sinks and streaming ingestion."""

import glob
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant import sinks
from foliant.operators.validation import IngestSettings
from foliant.streaming import ingest as I


def test_shards(spark, tmp_path):
    df = spark.range(10).coalesce(1)
    sinks.write_shards(df, f"{tmp_path}/a", 4)
    assert len(glob.glob(f"{tmp_path}/a/*.parquet")) == 3
    with pytest.raises(PySparkException):
        sinks.write_shards(df, f"{tmp_path}/a", 4)
    with pytest.raises(ValueError):
        sinks.write_shards(df, f"{tmp_path}/b", 0)
    for n in (1, 4):
        sinks.write_files(spark.range(100), f"{tmp_path}/n{n}", n)
        assert len(glob.glob(f"{tmp_path}/n{n}/*.parquet")) == n


def test_splits(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("train", 2), ("test", 3)], "split string, x int")
    assert sinks.write_splits(df, str(tmp_path)) == {"train": 2, "test": 1}
    assert json.loads(spark.read.text(f"{tmp_path}/dataset_info").first()[0]) == {"splits": {"train": 2, "test": 1}}


def test_ingestion_resumes(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "document_id string, full_text string"
    take = lambda: I.ingest(spark, source, schema, target, f"{tmp_path}/checkpoint", IngestSettings(chunk_size=20, overlap=5))
    spark.createDataFrame([("a", "words " * 10), ("b", None), ("a", "words " * 10)], schema).coalesce(1).write.parquet(source)
    take()
    rows = {r.document_id: r for r in I.tracker(spark, target).collect()}
    assert rows["a"].success and rows["a"].chunks_count > 1 and not rows["b"].success and rows["b"].error_message == "no text"
    n = I.chunks(spark, target).count()
    spark.createDataFrame([("a", "again"), ("b", "now with text"), ("c", "new")], schema).coalesce(1).write.mode("append").parquet(source)
    take()
    take()  # nothing new: nothing happens
    stats = I.tracker_stats(I.tracker(spark, target)).first()
    assert (stats.total, stats.successful, stats.failed) == (3, 3, 0)
    assert I.chunks(spark, target).where("document_id = 'a'").count() == n
    assert I.without_matching(I.tracker(spark, target), "B").count() == 2


def test_sources(spark, tmp_path):
    from foliant.sources import files

    (tmp_path / "train.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "test.json").write_text('[{"x": 3}]')
    df = files.read_splits(spark, str(tmp_path), ["train", "test"])
    assert sorted(map(tuple, df.select("split", "x").collect())) == [("test", 3), ("train", 1), ("train", 2)]
    with pytest.raises(ValueError):
        files.read_splits(spark, str(tmp_path), ["dev"])
    assert [len(b) for b in files.batches(spark.range(5), 2)] == [2, 2, 1] and list(files.batches(spark.range(0), 2)) == [[]]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [files.cached(spark, f"{tmp_path}/c", make).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    pages = spark.createDataFrame([("d1", ["a"]), ("d1", ["b", "c"]), ("d2", ["x"])], "day string, ids array<string>")
    reported = spark.createDataFrame([("d1", 3), ("d2", 2), ("d3", 0)], "day string, n int")
    assert {r.day: r.agrees for r in files.reconciled(pages, reported, "day", "ids", "n").collect()} == {"d1": True, "d2": False, "d3": True}


def test_model_contracts(spark):
    from foliant.operators import models

    df = spark.createDataFrame([(1, "a"), (2, None)], "idx int, t string")
    assert [list(r.embedding) for r in models.embed(df, "t", lambda ts: [[len(t), 1.0] for t in ts], 2).orderBy("idx").collect()] == [[1.0, 1.0], [0.0, 1.0]]
    assert [list(r.embedding) for r in models.embed(df, "t", lambda ts: 1 / 0, 2).collect()] == [[0.0, 0.0]] * 2
    assert {r.error for r in models.generate(df, "t", lambda ts: 1 / 0).collect()} == {"ZeroDivisionError: division by zero"}
    request = json.loads(models.judge_requests(df.where("idx = 1"), "Judge {t}", ["t"], "m").first().request)
    assert request["custom_id"] == "1" and request["body"]["messages"][0]["content"] == "Judge a"


def test_chunks_are_folders_of_consecutive_rows(spark):
    from foliant.sources import files

    df = spark.range(0, 1003, 1, 7).select("id", (F.col("id") % 3).alias("_part"))
    found = [sorted(r.id for r in part.collect()) for part in files.chunks(df, 100)]
    assert [len(c) for c in found] == [100] * 10 + [3] and [i for c in found for i in c] == list(range(1003))
    assert list(files.chunks(df.where("false"), 10)) == []
    part = files.numbered_chunks(df, 100).where("chunk = 4")
    assert part.count() == 100 and {f.split("chunk=")[1].split("/")[0] for f in part.inputFiles()} >= {"4"}
