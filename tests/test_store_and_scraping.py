"""The two-phase store writer under failures, and the scraper on a site that cannot be relied on."""

import glob

import pytest

from foliant.sources import scraping as P
from foliant.store_writer import FolderStore, write_objects

SCHEMA = "id string, name string, vector array<double>"


def objects(spark, *ids, name="a"):
    return spark.createDataFrame([(i, name, [1.0]) for i in ids], SCHEMA)


def held(spark, store):
    return sorted((r.id, r.name) for r in store.read(spark, SCHEMA).collect())


def test_objects_are_there_once(spark, tmp_path):
    store = FolderStore(f"{tmp_path}/store")
    assert held(spark, store) == []
    write_objects(objects(spark, *[f"o{i}" for i in range(50)]).repartition(5), store)
    assert held(spark, store) == sorted((f"o{i}", "a") for i in range(50))
    write_objects(objects(spark, "o1", "new", name="b"), store)
    assert held(spark, store) == sorted([(f"o{i}", "b" if i == 1 else "a") for i in range(50)] + [("new", "b")])
    write_objects(objects(spark), store)
    assert len(held(spark, store)) == 51


def test_refused_objects_are_kept_apart(spark, tmp_path):
    def refuse(batch):
        return ["too short" if len(n or "") < 2 else None for n in batch.column("name").to_pylist()]

    store = FolderStore(f"{tmp_path}/store")
    df = objects(spark, "a", "b", None, name="good").union(objects(spark, "c", name="x")).union(spark.createDataFrame([("d", None, None)], SCHEMA))
    write_objects(df.coalesce(2), store, refuse=refuse)
    assert held(spark, store) == [("a", "good"), ("b", "good")]
    assert sorted((r.id or "", r.error) for r in store.refused(spark).collect()) == [("", "no id"), ("c", "too short"), ("d", "too short")]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    def refuse(batch):
        if "bad" in batch.column("id").to_pylist():
            raise OSError("store is down")
        return [None] * batch.num_rows

    store = FolderStore(f"{tmp_path}/store")
    write_objects(objects(spark, "kept"), store)
    with pytest.raises(Exception, match="store is down"):
        write_objects(objects(spark, *[f"o{i}" for i in range(20)], "bad").repartition(4), store, refuse=refuse)
    assert held(spark, store) == [("kept", "a")] and len(glob.glob(f"{tmp_path}/store/objects/*/*")) == 1


def test_a_retried_task_stages_once(spark, tmp_path):
    from foliant.store_writer import Staged, _Writer

    store = FolderStore(f"{tmp_path}/store")
    writer, batches = _Writer(store, "id", None), objects(spark, "a", "b").toArrow().to_batches()
    writer.write(iter(batches))  # the attempt whose result was lost
    writer.commit([writer.write(iter(batches)), None])
    assert held(spark, store) == [("a", "a"), ("b", "a")] and len(glob.glob(f"{tmp_path}/store/objects/*/*")) == 1
    assert isinstance(Staged([], [], 0, 0), object)


def site():
    class Site:
        docs = {"d1": 25, "d2": 0, "d3": 12, "d4": 30, "d5": 8}

        def reported(self, day, attempt, round_):
            if day == "d6":
                raise OSError("no count")
            if day == "d4" and attempt == 1:
                raise TimeoutError("slow")
            return self.docs[day] - (10 if day == "d3" and round_ == 0 else 0)

        def listed(self, day, page, attempt, round_):
            if day == "d1" and page == 1 and attempt == 1:
                raise TimeoutError("slow")
            if day == "d4" and page == 2:
                raise OSError("dead page")
            if day == "d5" and round_ == 0:
                raise OSError("down for now")
            return [f"{day}-{i}" for i in range(page * 10, min(self.docs[day], page * 10 + 10))]

    return Site()


def test_scraping_plans_fetches_and_plans_again(spark):
    days = spark.createDataFrame([(d,) for d in ("d1", "d2", "d3", "d4", "d5", "d6", "d1", None)], "day string")
    pages, told = P.scrape(days, site(), P.Patience(10, 2, 0.0, 3))
    days_ = {r.day: (r.n_reported, r.n_listed, r.n_dead, r.settled) for r in told.collect()}
    assert days_ == {"d1": (25, 25, 0, True), "d2": (0, 0, 0, True), "d3": (12, 12, 0, True), "d4": (30, 20, 1, False), "d5": (8, 8, 0, True), "d6": (None, 0, 0, False)}
    found = {(r.day, r.page): (r.attempts, len(r.ids or []), r.error) for r in pages.collect()}
    assert found[("d1", 1)] == (2, 10, None) and found[("d4", 2)] == (2, 0, "dead page") and found[("d5", 0)][1] == 8 and len(found) == 3 + 2 + 3 + 1
    assert {r.day: r.count_error for r in told.collect()}["d6"] == "no count"


def test_no_days(spark):
    pages, told = P.scrape(spark.createDataFrame([], "day string"), site(), P.Patience(wait=0.0))
    assert pages.collect() == [] and told.collect() == []
