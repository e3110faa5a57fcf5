"""Pulled and filtered services over served tables: every version once, late updates, failures, pushed filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.sources import services as S

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, note string, ts timestamp_ntz"


def write(spark, path, rows, files=4):
    made = spark.createDataFrame([(i, note, START + dt.timedelta(hours=h)) for i, note, h in rows], SCHEMA)
    made.repartitionByRange(files, "ts").sortWithinPartitions("ts", "id").write.mode("overwrite").parquet(path)


def pulled(spark, tmp_path, service, name, **options):
    query = S.pull(spark, name, service, SCHEMA, wait=0.0, **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("id", "note").collect())


def test_two_runs_give_every_version_once(spark, tmp_path):
    path = f"{tmp_path}/served"
    rows = [(i, "a", i % 50) for i in range(200)]
    write(spark, path, rows)
    service = S.ServedTable(path, "ts", "id")
    assert pulled(spark, tmp_path, service, "pull_a", size=7) == sorted((i, "a") for i in range(200))
    late = [(i, "b", 60 + i % 3) if i % 10 == 0 else r for i, r in enumerate(rows)] + [(500, "new", 70)]
    write(spark, path, late)
    second = pulled(spark, tmp_path, service, "pull_b", size=7)
    assert second == sorted([(i, "a") for i in range(200)] + [(i, "b") for i in range(0, 200, 10)] + [(500, "new")])
    assert pulled(spark, tmp_path, service, "pull_c", size=7) == second  # nothing new


def test_from_a_time_on_and_failures(spark, tmp_path):
    path = f"{tmp_path}/served"
    write(spark, path, [(i, "a", i) for i in range(30)])
    since = (START + dt.timedelta(hours=19)).isoformat()
    assert pulled(spark, tmp_path, S.ServedTable(path, "ts", "id"), "pull_d", since=since) == [(i, "a") for i in range(20, 30)]


def test_tried():
    seen = []

    def call(attempt):
        seen.append(attempt)
        if attempt < 3:
            raise TimeoutError("later")
        return "done"

    assert S.tried(call, 3, 0.0) == ("done", 3) and seen == [1, 2, 3]
    with pytest.raises(TimeoutError):
        S.tried(call, 2, 0.0)
    with pytest.raises(ZeroDivisionError) as told:
        S.tried(lambda _: 1 / 0, 5, 0.0)
    assert told.value.attempts == 1


def test_pages_and_slices(spark, tmp_path):
    path = f"{tmp_path}/served"
    write(spark, path, [(i, "a", i % 5) for i in range(40)])
    service = S.ServedTable(path, "ts", "id")
    slices = service.slices(S.FIRST, service.newest())
    assert slices[0][0] == S.FIRST and slices[-1][1] == service.newest() and all(a[1] == b[0] for a, b in zip(slices, slices[1:])) and len(slices) > 1
    got, after, last = [], S.FIRST, None
    while (page := service.page(after, last, service.newest(), 3, ["id"])).num_rows:
        got += page.column("id").to_pylist()
        after, last = page.column("ts")[-1].as_py().isoformat(), page.column("id")[-1].as_py()
    assert got == sorted(range(40), key=lambda i: (i % 5, i))


def test_filters_reach_the_files(spark, tmp_path):
    path = f"{tmp_path}/served"
    write(spark, path, [(i, "even" if i % 2 == 0 else None, i) for i in range(100)], files=5)
    table = S.ServedTable(path, "ts", "id")
    df = S.filtered(spark, "filtered_a", table, "id long, note string", "id >= 70 and id < 75 and note is not null and length(note) = 4")
    assert sorted(r.id for r in df.collect()) == [70, 72, 74] and df.columns == ["id", "note"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "(length(note" in plan and ">= 70" not in plan and "isnotnull" not in plan
    reader = S._FilteredReader(table, ["id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
    left = list(reader.pushFilters([GreaterThan(("id",), 94), StringContains(("note",), "e")]))
    assert left == [StringContains(("note",), "e")] and len(list(reader.partitions())) == 1
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [5]
    none = S._FilteredReader(table, ["id"])
    assert list(none.pushFilters([EqualTo(("id",), 1000)])) == [] and [list(none.read(p)) for p in none.partitions()] == [[]]
    assert S.filtered(spark, "filtered_b", table, "id long").agg(F.count("*")).first()[0] == 100


def test_content_is_asked_for_once_a_key(spark, tmp_path):
    def service(folder):
        def fetch(key, attempt):
            with open(f"{folder}/asked", "a") as out:
                out.write(f"{key}\n")
            if key == 3 or key == 2 and attempt == 1:
                raise TimeoutError("later")
            return None if key == 1 else f"text {key}"

        return fetch

    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (4, "e"), (None, "f")], "id long, note string")
    found = S.with_content(items, "id", service(str(tmp_path)), attempts=2, wait=0.0)
    for _ in range(2):  # read twice, asked once
        rows = {r.note: (r.id, r.content, r.error) for r in found.collect()}
    assert rows == {"a": (1, None, None), "b": (2, "text 2", None), "c": (2, "text 2", None), "d": (3, None, "later"), "e": (4, "text 4", None), "f": (None, None, None)}
    assert sorted((tmp_path / "asked").read_text().split()) == ["1", "2", "2", "3", "3", "4"]
    assert S.with_content(items.where("false"), "id", service(str(tmp_path))).collect() == []


def test_a_page_reads_the_row_groups_it_lies_in(spark, tmp_path, monkeypatch):
    """Also where one time has more rows than a row group."""
    path = f"{tmp_path}/served"
    rows = spark.range(0, 20_000, 1, 1).select("id", F.lit("a").alias("note"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.floor(F.col("id") / 8000).cast("int"))).alias("ts"))
    rows.repartitionByRange(4, "ts", "id").sortWithinPartitions("ts", "id").write.option("parquet.block.size", 4096).parquet(path)
    service, read = S.ServedTable(path, "ts", "id"), []
    assert len(service._ordered()) >= 4
    monkeypatch.setattr(S.ServedTable, "_read", lambda self, part, names, whole=S.ServedTable._read: read.append(part) or whole(self, part, names))
    got, after, last, most = [], S.FIRST, None, 0
    while (page := service.page(after, last, service.newest(), 500, ["id"])).num_rows:
        got += page.column("id").to_pylist()
        after, last, most = page.column("ts")[-1].as_py().isoformat(), page.column("id")[-1].as_py(), max(most, len(read))
        read.clear()
    assert got == list(range(20_000)) and most < len(service._ordered()) / 4
