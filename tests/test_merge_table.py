"""The merge-on-read table against a plain dictionary, over generations, compaction, late changes and replays."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.merge_table import Conflict, MergeTable

SCHEMA = "id long, name string, n int"


def state(table, **options):
    return {r.id: (r.name, r.n) for r in table.read(**options).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return MergeTable(spark, f"{tmp_path}/t", "id", SCHEMA, buckets=4)


def rows(spark, *made):
    return spark.createDataFrame(list(made), SCHEMA)


def test_generations_deletes_and_fields(spark, table):
    assert state(table) == {}
    table.upsert(rows(spark, (1, "a", 1), (2, "b", 2), (3, None, 3)))
    table.upsert(rows(spark, (2, None, 9)).select("id", "n"))
    assert state(table) == {1: ("a", 1), 2: ("b", 9), 3: (None, 3)}
    table.upsert(rows(spark, (1, None, None), (4, "d", None)), present={"n": F.col("n").isNotNull()})
    assert state(table) == {1: (None, 1), 2: ("b", 9), 3: (None, 3), 4: ("d", None)}
    table.delete(rows(spark, (2, None, None), (77, None, None)))
    table.upsert(rows(spark, (2, "back", None)).select("id", "name"))
    assert state(table)[2] == ("back", None) and 77 not in state(table)
    table.insert(rows(spark, (2, "no", 0), (5, "new", 5)))
    assert state(table)[2] == ("back", None) and state(table)[5] == ("new", 5)
    table.update_by(lambda df: df.select("id", (F.col("n") * 10).alias("n")), F.col("n") > 2)
    assert state(table) == {1: (None, 1), 2: ("back", None), 3: (None, 30), 4: ("d", None), 5: ("new", 50)}
    assert state(table, as_of=1) == {1: ("a", 1), 2: ("b", 2), 3: (None, 3)}


def test_random_changes_with_late_ones(spark, table):
    rng, expected, log = random.Random(2), {}, []
    for gen in range(1, 9):
        batch = {}
        for _ in range(25):
            key, at = rng.randrange(30), rng.randrange(1000) * 10 + gen
            batch[key] = (key, rng.choice((None, f"v{at}")), rng.randrange(9), at, rng.random() < 0.2)
        log += list(batch.values())
        made = spark.createDataFrame(list(batch.values()), SCHEMA + ", at long, gone boolean")
        table.apply(made, F.col("gone"), present={"name": F.col("name").isNotNull()}, order="at")
        if gen in (3, 6):
            assert table.compact(1)
    for key, name, n, at, gone in sorted(log, key=lambda r: r[3]):
        if gone:
            expected.pop(key, None)
        else:
            old = expected.get(key, (None, None))
            expected[key] = (name if name is not None else old[0], n)
    assert state(table) == expected
    table.compact(0)
    assert state(table) == expected and {k: v for k in (0, 7, 99) if (v := {r.id: (r.name, r.n) for r in table.find([k]).collect()}.get(k))} == {k: expected[k] for k in (0, 7) if k in expected}


def test_compaction_and_vacuum(spark, table):
    for i in range(6):
        table.upsert(rows(spark, *[(k, f"g{i}", i) for k in range(10)]))
    before = state(table)
    assert table.compact(5) == [0, 1, 2, 3] and table.compact(5) == []
    assert state(table) == before and all(len(g) == 1 for g in table.live().values())
    assert "HashAggregate" not in table.read()._jdf.queryExecution().executedPlan().toString()
    assert table.vacuum() == 6 and state(table) == before


def test_a_small_change_reads_nothing_and_find_opens_one_bucket(spark, table):
    table.upsert(rows(spark, *[(k, "x", k) for k in range(200)]))
    table.compact(0)
    table.upsert(rows(spark, (7, "y", None)).select("id", "name"))
    files = table.find([7]).inputFiles()
    assert len({f.split("_bucket=")[1].split("/")[0] for f in files}) == 1
    opened = [g for g, f in ((int(f.split("_gen=")[1].split("/")[0]), f) for f in table.read().inputFiles())]
    assert opened.count(3) == 1  # the change is one file of one bucket
    assert "PushedFilters: [In(id, [7])" in table.find([7])._jdf.queryExecution().executedPlan().toString() or "EqualTo(id,7)" in table.find([7])._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.name, r.n) for r in table.find([7]).collect()] == [(7, "y", 7)] and table.find([]).collect() == []


def test_tokens_and_conflicts(spark, table, monkeypatch):
    assert table.upsert(rows(spark, (1, "a", 1)), token="batch 0") == 1
    assert table.upsert(rows(spark, (1, "b", 2)), token="batch 0") is None and state(table) == {1: ("a", 1)}
    other = MergeTable(spark, table.path, "id", SCHEMA, buckets=4)
    monkeypatch.setattr(other, "commits", lambda: [])  # has not seen the first generation
    with pytest.raises(Conflict):
        other.upsert(rows(spark, (2, "c", 3)))


def test_null_keys_and_reserved_names(spark, table, tmp_path):
    with pytest.raises(Exception, match="null key"):
        table.upsert(rows(spark, (None, "a", 1)))
    with pytest.raises(ValueError):
        MergeTable(spark, f"{tmp_path}/u", "id", "id long, _drop int")
    table.upsert(rows(spark).where("false"))
    assert state(table) == {}
