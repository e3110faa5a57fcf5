"""Ingestion with keyed state: resume, retries by timers, dead letters, reset, forgetting, constant reads."""

import datetime as dt

import pytest

from foliant.streaming import keyed as K

SCHEMA = "id string, text string, lang string, ts timestamp, forget boolean"
START = dt.datetime(2024, 1, 1)


def service():
    def process(text, attempt):  # of no module, so that it is sent as it is
        if "always" in text:
            raise OSError("service is down")
        if "once" in text and attempt == 1:
            raise TimeoutError("took too long")
        if "bad" in text:
            raise ValueError("cannot be cut")
        return text.split("|")

    return process


@pytest.fixture
def stream(spark, tmp_path):
    def feed(*rows, minute=0, **options):
        made = [(i, t, "en", START + dt.timedelta(minutes=minute), forget) for i, t, *rest in rows for forget in (rest or [False])[:1]]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        K.ingest_keyed(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "id", "text", service(), attributes=["lang"], arrived="ts", retry=K.Retry(3, 60_000), reset="forget", **options)
        return {r.document_id: (r.n_attempts, r.success, r.dead, r.chunks_count, r.error_message) for r in K.keyed_tracker(spark, f"{tmp_path}/out").collect()}

    feed.folder = f"{tmp_path}/out"
    return feed


def chunks(spark, folder):
    return sorted((r.document_id, r.attempt, r.chunk_id, r.chunk_text, r.lang) for r in K.output(spark, folder, K.OUTPUT + ", lang string").where("kind = 'chunk'").collect())


def test_retries_dead_letters_and_repeats(spark, stream):
    seen = stream(("a", "x|y"), ("a", "x"), ("once", "once|z"), ("always", "always"), ("bad", "bad"), ("empty", " "), (None, "t"))
    assert seen == {"a": (1, True, False, 2, None), "once": (1, False, False, 0, "took too long"), "always": (1, False, False, 0, "service is down"), "bad": (1, False, True, 0, "cannot be cut"), "empty": (1, False, True, 0, "no text")}
    seen = stream(("a", "other"), ("b", "b"), minute=2)  # the watermark passes the timers of minute 1
    assert seen["a"] == (1, True, False, 2, None) and seen["once"] == (2, True, False, 2, None) and seen["always"][:3] == (2, False, False)
    seen = stream(("bad", "good now"), minute=5)
    assert seen["always"] == (3, False, True, 0, "service is down") and seen["bad"] == (2, True, False, 1, None)
    assert stream(("always", "always"), minute=30)["always"] == (4, False, False, 0, "service is down")
    assert chunks(spark, stream.folder) == [("a", 1, 0, "x", "en"), ("a", 1, 1, "y", "en"), ("b", 1, 0, "b", "en"), ("bad", 2, 0, "good now", "en"), ("once", 2, 0, "once", "en"), ("once", 2, 1, "z", "en")]
    assert {r.document_id for r in K.keyed_dead_letters(spark, stream.folder).collect()} == {"empty"}


def test_reset_and_forgetting(spark, stream):
    stream(("a", "x"), ("b", "y"), keep_ms=3_600_000)
    assert set(stream(("a", None, True), minute=1, keep_ms=3_600_000)) == {"b"}
    assert stream(("a", "again|z"), minute=2, keep_ms=3_600_000)["a"] == (2, True, False, 2, None)
    assert stream(("c", "c"), minute=100, keep_ms=3_600_000)["b"][0] == 1  # b's hour is over
    assert stream(("b", "new"), minute=101, keep_ms=3_600_000)["b"] == (2, True, False, 1, None)


def test_counters_and_reads_of_a_batch(spark, stream):
    stream(*[(f"d{i}", "x|y") for i in range(400)])
    for minute in (1, 2, 3):
        stream(*[(f"d{i}", "x|y") for i in range(395, 405)], minute=minute)
    told = {r.batch_id: r for r in K.keyed_progress(spark, stream.folder).collect()}
    full = [told[b] for b in sorted(told) if told[b].n_input]
    assert [(r.n_input, r.n_attempts, r.n_failed, r.n_chunks) for r in full] == [(400, 400, 0, 800), (10, 5, 0, 10), (10, 0, 0, 0), (10, 0, 0, 0)]
    assert full[-1].state_rows >= 405 and full[1].state_reads <= 60 and full[3].state_reads <= full[1].state_reads  # of ten documents, not of all


def test_clock_time_without_arrivals(spark, tmp_path):
    spark.createDataFrame([("a", "once"), ("b", "t|u")], "id string, text string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id string, text string").parquet(f"{tmp_path}/in")
    K.ingest_keyed(source, f"{tmp_path}/out", f"{tmp_path}/c", "id", "text", service())
    assert {r.document_id: r.success for r in K.keyed_tracker(spark, f"{tmp_path}/out").collect()} == {"a": False, "b": True}


def test_nothing_arrived(spark, tmp_path):
    assert K.keyed_tracker(spark, f"{tmp_path}/none").collect() == []


def test_shards_tell_the_same(spark, stream):
    """Documents that share a state: repeats, retries, dead letters, reset and forgetting as with states of their own."""
    feed = lambda *rows, minute=0: stream(*rows, minute=minute, shards=2, keep_ms=3_600_000)
    seen = feed(("a", "x|y"), ("a", "x"), ("once", "once|z"), ("always", "always"), ("bad", "bad"), ("empty", " "), (None, "t"))
    assert seen == {"a": (1, True, False, 2, None), "once": (1, False, False, 0, "took too long"), "always": (1, False, False, 0, "service is down"), "bad": (1, False, True, 0, "cannot be cut"), "empty": (1, False, True, 0, "no text")}
    seen = feed(("a", "other"), ("b", "b"), minute=2)
    assert seen["a"] == (1, True, False, 2, None) and seen["once"] == (2, True, False, 2, None) and seen["always"][:3] == (2, False, False)
    seen = feed(("bad", "good now"), ("b", None, True), minute=5)
    assert seen["always"] == (3, False, True, 0, "service is down") and seen["bad"] == (2, True, False, 1, None) and "b" not in seen
    feed(("c", "c"), minute=100)  # a's hour is over
    assert feed(("a", "new"), ("c", "more"), minute=101)["a"] == (2, True, False, 1, None)
    assert chunks(spark, stream.folder) == [("a", 1, 0, "new", "en"), ("a", 1, 0, "x", "en"), ("a", 1, 1, "y", "en"), ("b", 1, 0, "b", "en"), ("bad", 2, 0, "good now", "en"), ("c", 1, 0, "c", "en"), ("once", 2, 0, "once", "en"), ("once", 2, 1, "z", "en")]
