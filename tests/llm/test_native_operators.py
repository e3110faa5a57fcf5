"""SQL operators against their oracles and stated properties over awkward documents."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.llm import fingerprints as FP, mixing as M, native_queries as Q, sharding as S
from oracle import compare


@pytest.fixture(scope="module")
def path(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("oracle"))
    docs.where("doc_id is not null or text is null").coalesce(1).write.mode("overwrite").parquet(path)
    return path


@pytest.fixture
def frame(spark, path):
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def con(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return con


def test_mixture_oracle(con, frame):
    mixed = M.mix(frame.select("doc_id", "text", "source"))
    ours = mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_position").alias("position"))
    assert compare(ours, con, Q.OP2_SQL) == ""


def test_mixture_meets_targets(docs):
    mixed = M.mix(docs)
    for r in mixed.groupBy("source").agg(F.sum("mix_taken").alias("taken"), F.first("mix_target").alias("target"), F.first("mix_source_size").alias("size")).collect():
        assert abs(r.taken - r.target) <= 1 and r.target <= 2 * r["size"] + 1e-9
    assert mixed.where("mix_taken > 2 * mix_size or mix_position < 0 or mix_position > 1").count() == 0
    budget = mixed.agg(F.sum("mix_size") * 1.5).first()[0]
    assert abs(sum(r[0] for r in mixed.select("source", "mix_target").distinct().select("mix_target").collect()) - budget) < 1e-6
    rows = M.mixture_rows(docs)
    assert rows.columns == docs.columns
    assert rows.agg(F.sum(F.regexp_count("text", F.lit(M.WORD)))).first()[0] == mixed.agg(F.sum("mix_taken")).first()[0]


def test_targets_stop_and_share_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in M.source_targets(sizes).collect()}
    assert found["a"] == 20 and found[None] == 0
    assert found["b"] == pytest.approx((2010 * 1.5 - 20) / 3) and found["c"] == pytest.approx(2 * found["b"])


def test_positions_invert_the_demand(spark):
    at = lambda y, rank: spark.range(1).select(M.position_at(F.lit(y), F.lit(rank))).first()[0]
    assert at(0.0, 0) == 0 and at(1.0, 0) == 1 and at(0.5, 1) == 0.5
    assert at(0.4, 0) == pytest.approx(0.25) and at(0.1, 2) == pytest.approx(0.25)


def test_fingerprint_oracle(con, frame):
    frame = frame.where("doc_id is not null")
    assert compare(FP.fingerprint(frame), con, Q.OP3_SQL.replace("FROM documents", "FROM documents WHERE doc_id IS NOT NULL", 1)) == ""


def test_fingerprints_of_awkward_rows(docs, rows):
    found = FP.fingerprint(docs)
    assert found.count() == len(rows)
    by_text = docs.select("text").distinct().count()
    joined = found.select("doc_id", "fingerprint").distinct().join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null"), "doc_id")
    assert joined.groupBy("text").agg(F.count_distinct("fingerprint").alias("n")).where("n > 1").count() == 0 and by_text > 10
    assert found.where("near_edited < 0 or near_edited > 1 or near_next < 0 or near_next > 1").count() == 0
    single = FP.fingerprint(docs.where("doc_id = 5")).first()
    assert single.near_next == 1.0


def test_containment_of_unequal_texts(spark):
    words = [f"w{i}" for i in range(4000)]
    passages = [(n, " ".join(words[at : at + n])) for n in (6, 30, 100, 400) for at in range(0, 3500, 40)]
    rows = spark.createDataFrame(passages, "n int, b string").withColumn("a", F.lit(" ".join(words))).select("n", FP.sketch(F.col("a")).alias("a"), FP.sketch(F.col("b")).alias("b"))
    rows = rows.select("n", FP.containment(F.col("b"), F.col("a")).alias("c"), FP.likeness(F.col("a"), F.col("b")).alias("like"), (FP.merge(F.col("a"), F.col("b")) == F.col("a")).alias("merged"), (F.size("b.low") > 0).alias("some")).collect()
    assert all(r.merged for r in rows)
    assert all(r.c == 1.0 if r.some else r.c is None for r in rows) and any(not r.some for r in rows)
    assert all(r.some and 0.05 < r.like < 0.2 for r in rows if r.n == 400)


def test_texts_without_a_sketch_compare_exactly(spark):
    short = [" ".join(f"{x}{i}" for i in range(7)) for x in "abcdefghijklmnop"]
    rows = spark.createDataFrame([(t, t.rsplit(" ", 1)[0]) for t in short], "a string, b string").select("a", FP.sketch(F.col("a")).alias("x"), FP.sketch(F.col("b")).alias("y"))
    rows = rows.where("size(x.low) = 0").select(FP.likeness(F.col("x"), F.col("y")), FP.containment(F.col("y"), F.col("x")), FP.containment(F.col("x"), F.col("y")), FP.shown(F.col("x"))).collect()
    assert rows and all(r[0] == pytest.approx(2 / 3) and r[1] == 1.0 and r[2] == pytest.approx(2 / 3) and r[3].startswith("~") for r in rows)


def test_next_texts_of_sparse_and_dense_ids(spark, con):
    ids = [3, 4, 5, 6, 2**40, 2**40 + 1, -(2**50), 7 * 10**17, 2**62 + 5, *[k * 977_777_777_777 for k in range(1, 60)]]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    found = {r.doc_id: r.next_text for r in FP.with_next(docs).collect()}
    order = sorted(ids)
    assert found == {i: f"text {n}" for i, n in zip(order, order[1:] + order[:1])}
    rows = docs.select(F.col("doc_id").alias("_id"))
    assert FP.low_bits(rows.where("_id between 0 and 10")) == 61 and FP.low_bits(spark.range(20_000).withColumnRenamed("id", "_id")) == 9
    heads = FP._heads(rows, 9, part_groups=5).collect()
    starts = {i >> 9: i for i in reversed(order)}
    groups = sorted(starts)
    assert {(r._to, r._head) for r in heads} == {(groups[k - 1], starts[g]) for k, g in enumerate(groups)}


def test_shard_oracle(con, frame):
    assert compare(S.assign_shards(frame), con, Q.OP10_SQL) == ""


def test_slots_are_gapless_and_growth_moves_rows_in(docs, rows, spark):
    found = S.assign_shards(docs).collect()
    assert len(found) == len(rows)
    slots = Counter((r.shard, r.slot) for r in found)
    for shard in {r.shard for r in found}:
        assert sorted(s for k, s in slots if k == shard) == list(range(sum(k == shard for k, _ in slots)))
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    moved = S.assign_shards(keys)
    assert moved.where("shard <> grown_shard and grown_shard <> 40").count() == 0
    assert 20_000 / 41 * 0.8 < moved.where("grown_shard = 40").count() < 20_000 / 41 * 1.2
    counts = [r["count"] for r in moved.groupBy("shard").count().collect()]
    assert len(counts) == 40 and max(counts) < 1.3 * 500 and min(counts) > 0.7 * 500


def test_weights_move_rows_within_their_subtree(spark):
    before = (((1.0, 1.0), (1.0, 1.0)), ((2.0, 1.0), (1.0,)))
    after = (((1.0, 1.0), (1.0, 1.0)), ((1.0, 2.0), (1.0,)))  # the rack's weight stays
    keys = spark.range(6000).withColumnRenamed("id", "doc_id")
    both = S.place(S.place(keys, F.col("doc_id"), before, "a"), F.col("doc_id"), after, "b")
    moved = {tuple(r) for r in both.where("a <> b").select("a", "b").distinct().collect()}
    assert moved and moved <= {(4, 5), (5, 4)} and S.shard_count(before) == 7
    share = both.where("a = 4").count() / 6000
    assert 0.18 < share < 0.27  # 2 of 8


def test_empty_tables(nothing):
    assert M.mix(nothing).count() == 0 and M.mixture_rows(nothing).count() == 0
    assert FP.fingerprint(nothing).count() == 0 and S.assign_shards(nothing).count() == 0
