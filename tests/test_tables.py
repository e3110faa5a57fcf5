"""Joins, quantiles, graphs, sinks and models on empty, null, tied and repeated rows."""

import json

import pytest
from pyspark.sql import functions as F

from foliant import sinks
from foliant.operators import chunking as C, evaluate as E, graph as G, models, profile as P, relational as R, search as S
from foliant.sources import files
from foliant.storage import discard, materialize


def test_best_rows_of_groups(spark):
    df = spark.createDataFrame([(1, "a", "xx", 3), (1, "b", "yy", 1), (None, "c", None, 2), (None, "d", "z", 4), (2, "e", None, 5)], "k int, name string, t string, p int")
    assert sorted(r.name for r in R.longest_per_group(df, ["k"], "t", "p").collect()) == ["b", "d", "e"]
    assert sorted(r.name for r in R.latest(df, "k", ["p"]).collect()) == ["a", "d", "e"]
    assert sorted((r.name, r.n_members) for r in R.repeated_members(df, ["k"]).collect()) == [("a", 2), ("b", 2), ("c", 2), ("d", 2)]
    assert sorted(r.name for r in R.first_by_content(df, "t", "p").collect()) == ["a", "b", "c", "d"]
    assert R.longest_per_group(df.where("false"), ["k"], "t", "p").count() == 0


def test_quantiles_from_counts(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), ("c", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: (r.p25, r.p50, r.p75, r.n_null) for r in P.described(df, "v", ["g"]).collect()}
    assert found == {"a": (1.75, 2.0, 4.0, 0), "b": (5.0, 5.0, 5.0, 0), "c": (None, None, None, 1), None: (1.25, 1.5, 1.75, 0)}
    assert P.quantiles(df, "v", [0.0, 1.0]).first()[:] == (1.0, 10.0)
    assert P.summary(df.where("false"), "v").first().median is None


def test_samples_and_pages(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    assert 300 < R.fraction(df, 0.2, "k").count() < 500 and R.fraction(df, 0, "k").count() == 0 and R.fraction(df, 1, "k").count() == 2000
    with pytest.raises(ValueError):
        R.fraction(df, 1.5, "k")
    assert [r.k for r in R.pages_up_to(df, 5, 2, ["k"]).collect()] == list(range(6)) and [r.k for r in R.page_at(df, 4, 2, ["k"]).collect()] == [4, 5]


def test_communities(spark):
    ring = [(a, b) for base in (0, 10, 20) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(0, 10), (10, 20)]
    edges = spark.createDataFrame(ring, "u long, v long")
    for find in (G.louvain, G.label_propagation):
        groups = {}
        for r in find(edges, "u", "v").collect():
            groups.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == [list(range(b, b + 4)) for b in (0, 10, 20)]
    assert G.louvain(edges.where("false"), "u", "v").count() == 0 and G.label_propagation(edges.where("false"), "u", "v").count() == 0


def test_graph_assertions_and_features(spark):
    edges = spark.createDataFrame([(1, 101), (1, 102), (2, 102), (3, 103)], "j long, b long")
    assert G.is_connected(edges, "j", "b").first()[:] == (2, False) and G.is_bipartite(edges, "j", "b").first()[:] == (0, True)
    index, lefts, _ = G.edge_index(edges, "j", "b")
    assert sorted(map(tuple, index.collect())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    vectors = spark.createDataFrame([(1, [1.0]), (2, [0.0])], "j long, e array<double>")
    with pytest.raises(Exception, match="a node without a vector"):
        G.left_features(lefts, vectors, "j", "e").collect()


@pytest.mark.parametrize("a, b, n", [("abcbdab", "bdcaba", 4), ("", "x", 0), ("aaa", "aa", 2), ("abc", "abc", 3), ("abc", "xyz", 0), ("ab" * 200, "ba" * 200, 399)])
def test_subsequences(a, b, n):
    assert E.subsequence_length(a, b) == E.subsequence_length(b, a) == n


def test_search_with_and_without_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b", None), (2, "B c", "a"), (3, None, None), (4, "", "b"), (5, "d", "d")], "doc_id long, text string, title string")
    S.index(docs, str(tmp_path), text=["text", "title"])
    one, two = S.bm25_indexed(spark, str(tmp_path), ["b", "A", "zz"], 10).collect(), S.bm25(docs, ["a", "b", "b"], 10, text=["text", "title"]).collect()
    assert [(r.doc_id, round(r.score, 9)) for r in one] == [(r.doc_id, round(r.score, 9)) for r in two] and {r.doc_id for r in one} == {1, 2, 4}
    assert S.bm25(docs, ["nowhere"], 5).count() == 0 and S.bm25(docs, ["b"], 5, offset=5).count() == 0


def test_named_shards_and_texts(spark, tmp_path):
    df = spark.range(10)
    assert sinks.write_named_shards(df, str(tmp_path), "x", 4) == [f"x_{i:02d}_of_03.parquet" for i in range(3)]
    with pytest.raises(FileExistsError):
        sinks.write_named_shards(df, str(tmp_path), "x", 4)
    assert len(sinks.write_named_shards(df, str(tmp_path), "x", 100, clean=True)) == 1 and spark.read.parquet(f"{tmp_path}/x_00_of_01.parquet").count() == 10
    with pytest.raises(ValueError):
        sinks.write_named_shards(df, str(tmp_path), "y", 0)
    assert sinks.yaml_text([{"a": "yes", "b": ["x y", 1, None], "c": {}, "d": "1"}]) == '-\n  a: "yes"\n  b:\n    - x y\n    - 1\n    - null\n  c: {}\n  d: "1"'
    assert sinks.latex_table(spark.createDataFrame([("50% & a_b", None)], "x string, y string")).split("\n")[4] == r"50\% \& a\_b &  \\"
    assert json.loads(json.dumps(sinks.node_link_object(spark.range(2), spark.createDataFrame([(0, 1)], "u long, v long"), "id", "u", "v"))) == {"nodes": [{"id": 0}, {"id": 1}], "links": [{"source": 0, "target": 1}]}


def test_updates_and_inserts(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = R.updated_by(stored, lambda d: d.select("k", F.upper("v").alias("v")), "k", F.col("k") == 2)
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "B")]
    assert sorted(map(tuple, R.inserted(stored, spark.createDataFrame([(2, "z"), (3, "c"), (3, "d")], "k int, v string"), "k").collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_models_fail_by_batch(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "idx int, t string").coalesce(1)
    calls = []

    def model(texts):
        if "t5" in texts:
            raise ValueError("five")
        return [t.upper() for t in texts]

    found = {r.idx: (r.answer, r.error) for r in models.generate(df, "t", model, batch=4, attempts=2).collect()}
    assert found[0] == ("T0", None) and found[9] == ("T9", None) and all(found[i] == (None, "ValueError: five") for i in range(4, 8)) and not calls


def test_padding_and_truncation(spark):
    class Letters:
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    df = spark.createDataFrame([(1, "abcd"), (2, ""), (3, None)], "idx int, context string")
    rows = {r.idx: r for r in C.truncated_by(df, Letters, 3).collect()}
    assert rows[1].context == "abc" and (rows[1].num_truncated_tokens, rows[1].truncated_ratio) == (1, 0.25) and rows[2].num_truncated_tokens == 0
    assert {r.context for r in C.truncated_by(df, Letters, 0).collect()} == {""}
    with pytest.raises(ValueError):
        C.truncated_by(df, Letters, 0, strict=True)
    padded = {r.idx: (r.input_ids, r.attention_mask) for r in C.padded(C.with_token_ids(df, Letters, "context"), "ids", 3).collect()}
    assert padded == {1: ([97, 98, 99], [1, 1, 1]), 2: ([0, 0, 0], [0, 0, 0]), 3: ([0, 0, 0], [0, 0, 0])}


def test_chunks_of_tables(spark):
    assert [p.count() for p in files.chunks(spark.range(0, 25, 1, 3), 10)] == [10, 10, 5] and list(files.chunks(spark.range(0), 10)) == []


def test_materialized_steps_go(spark):
    import os

    first = materialize(spark.range(5), "first")
    path = first._foliant_path.removeprefix("file:")
    second = materialize(first.where("id > 1"), "second", first, parts=1)
    assert not os.path.exists(path) and second.count() == 3
    discard(second, spark.range(1))
    assert not os.path.exists(second._foliant_path.removeprefix("file:"))
