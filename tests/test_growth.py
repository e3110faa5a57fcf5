"""Work on short rows is dealt over the cores, and what grows with the tables has no constant of small ones."""

import sys
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

sys.path.insert(0, str(Path(__file__).parent))
from foliant.operators import graph, models, parsing, search
from foliant.plans import catalog, markup_queries as M
from foliant.sources import scraping, services
from foliant.streaming import keyed

SF = "/root/testdata/sf0.001"


def _tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_short_rows_are_dealt_over_the_cores(spark):
    """A file of many short rows is one part; pages, answers of models and YAML are worked on in several."""
    cores = spark.sparkContext.defaultParallelism
    assert _tasks(M._judgment_pages(spark, SF)) >= cores
    assert _tasks(models.generate(spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("p")), "p", list)) >= cores
    assert _tasks(catalog.queries()["yaml_answers"](spark, SF)) >= cores


def test_pages_are_parsed_once(spark):
    """No second run of the parser as a pushed filter."""
    for name in ("judgment_page_acts", "judgment_page_dates", "search_pages_reconciled"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


def test_single_answers_take_linear_time(spark):
    """Batches of one: no table is built for each of them."""
    taken = []
    model = lambda prompts: prompts
    rows = spark.range(0, 20_000, 1, 1).select(F.col("id").cast("string").alias("p"))
    models.generate(rows.limit(10), "p", model, batch=1).collect()
    start = time.monotonic()
    assert models.generate(rows, "p", model, batch=1).where("answer = p and error is null").count() == 20_000
    taken.append(time.monotonic() - start)
    assert taken[0] < 5


@pytest.mark.parametrize("name, size", [("row_batches", 700), ("table_chunks", 400)])
def test_oracles_hold_for_any_number_of_rows(name, size):
    """The last batch of a million parts is in the oracle's rows too."""
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT i AS p_partkey FROM range(1000001) r(i)")
    rows = con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert len(rows) == -(-1_000_001 // size) and int(rows["n_rows"].sum()) == 1_000_001
    con.execute("CREATE OR REPLACE VIEW part AS SELECT 1 AS p_partkey WHERE false")
    assert not len(con.execute(catalog.oracle_sql()[name]).fetchdf())


def test_oracle_of_pages_reads_references_without_semicolon():
    """As HTML does: a title that is cut inside of a reference."""
    html = "<html><head><title>a &amp;&amp &lt;b&gt &#39c&#39 &quot</title></head><body><p>x &amp y&nbsp;z &amp;lt &copy</p></body></html>"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [html])
    told = {name: con.execute(catalog.oracle_sql()[name]).fetchone()[-1] for name in ("pages_title", "pages_text")}
    assert told == {"pages_title": parsing.page_title(html), "pages_text": parsing.visible_text(html)}
    assert told["pages_title"] == "a && <b> 'c' \""


@pytest.mark.parametrize("find", [graph.louvain, graph.leiden])
def test_no_two_nodes_change_places_for_ever(spark, find):
    """Pairs apart from each other: whatever their hashes, each becomes one community."""
    pairs = spark.range(60).select((F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v"))
    assert [tuple(r) for r in graph.community_sizes(find(pairs, "u", "v")).collect()] == [(2, 60)]


@pytest.mark.parametrize("n", [1, 148])
def test_customers_who_know_nobody_are_communities(spark, tmp_path, n):
    """The last group may be a single customer, who has no edge."""
    spark.range(n).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT i AS c_custkey FROM range({n}) r(i)")
    told = con.execute(catalog.oracle_sql()["community_sizes"]).fetchall()
    assert sorted(tuple(r) for r in catalog.queries()["community_sizes"](spark, str(tmp_path)).collect()) == sorted(told)


def test_look_ups_read_a_row_group_once(spark, tmp_path, monkeypatch):
    """Neighbouring keys and the pages of a day cost one reading, not one each."""
    table = spark.range(0, 4000, 1, 4).select("id", F.concat(F.lit("day"), F.floor(F.col("id") / 1000)).alias("day"), F.col("id").cast("string").alias("text"))
    table.write.parquet(str(tmp_path / "t"))
    read = []
    whole = services.ServedTable.dataset
    monkeypatch.setattr(services.ServedTable, "dataset", lambda self: read.append(1) or whole(self))
    served = services.ServedTable(str(tmp_path / "t"), "day", "id")
    for key in range(4000):
        rows = served.column_at(key, "id", "text")
        assert rows.num_rows == 1000 and rows.column("text")[key % 1000].as_py() == str(key)
    assert not served.column_at(4000, "id", "text").num_rows and len(read) == 1
    site = scraping.ServedSite(served)
    pages = [site.listed(f"day{d}", page, 1, 0) for d in range(4) for page in range(100)]
    assert sorted(int(k) for p in pages for k in p) == list(range(4000)) and len(read) == 5


def test_new_documents_cost_two_calls_of_the_state(spark):
    """A document that never failed cannot wait, so its text is not looked for."""

    class Value:
        def __init__(self):
            self.calls = []

        def get(self):
            self.calls.append("get")

        def update(self, value):
            self.calls.append("update")

    machine = keyed.Documents(lambda text, attempt: [text], keyed.Retry(), [], StructType([]), None, 0)
    machine.stands, machine.waiting = Value(), Value()
    rows = [{"full_text": "a", "_now": 1, "_reset": False}]
    assert len(list(machine.handleInputRows(("k",), iter(rows), None))) == 2
    assert machine.stands.calls == ["get", "update"] and machine.waiting.calls == []


def test_documents_of_a_shard_share_the_calls_of_the_state(spark):
    """However many documents arrive, wait or are tried again: a shard is read once, written once and has one timer."""
    calls, held, timers = [], {}, set()

    class Value:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return held.get(self.name)

        def update(self, value):
            calls.append("update")
            held[self.name] = value

    class Handle:
        def getValueState(self, name, schema):
            return Value(name)

        def registerTimer(self, due):
            calls.append("timer")
            timers.add(due)

        def deleteTimer(self, due):
            calls.append("timer")
            timers.remove(due)

    class Time:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now

    def process(text, attempt):
        if int(text) % 50 == 0 or int(text) % 5 == 0 and attempt == 1:
            raise TimeoutError("late")
        return [text, "|"]

    def rows(packed):
        return [dict(zip(row, values)) for row in (r.asDict() for r in packed) for values in zip(*row.values())]

    machine = keyed.Shards(process, keyed.Retry(3, 1000), [], StructType([]), None, 0)
    machine.init(Handle())
    arrived = [{"document_id": str(i), "full_text": str(i), "_now": i, "_reset": False} for i in range(1000)]
    told = rows(machine.handleInputRows((0,), iter(arrived), Time(0)))
    assert sum(r["kind"] == "attempt" for r in told) == 1000 and sum(r["kind"] == "chunk" for r in told) == 1600 and timers == {1000}
    assert len(calls) <= 5
    for now in (9000, 99_000):
        timer = timers.pop()
        calls.clear()
        told += rows(machine.handleExpiredTimer((0,), Time(max(now, timer)), Time(timer)))
        assert len(calls) <= 6
    last = {r["document_id"]: r for r in told if r["kind"] == "attempt"}
    assert all((r["attempt"], r["success"], r["dead"]) == ((3, False, True) if int(d) % 50 == 0 else (2, True, False) if int(d) % 5 == 0 else (1, True, False)) for d, r in last.items())
    assert not timers and held["texts"] == ([],) and not rows(machine.handleInputRows((0,), iter(arrived[1:5]), Time(99_000)))


def test_items_are_scored_without_joins(spark):
    """Judged items are dealt over the cores; nothing is grouped, joined or computed that no column needs."""
    df = catalog.queries()["judged_items"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Join", "Aggregate", "ArrowEvalPython")) and _tasks(df) >= spark.sparkContext.defaultParallelism


def test_postings_are_counted_in_their_rows(spark):
    """The only shuffle of an index is the one that sorts it."""
    docs = spark.createDataFrame([(1, "b A b  a c"), (2, ""), (3, None), (4, "x " * 3000 + "y")], "doc_id long, text string")
    found = search.postings(docs, "doc_id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.term, r.length, r.tf) for r in found.collect()) == [(1, "a", 5, 2), (1, "b", 5, 2), (1, "c", 5, 1), (4, "x", 3001, 3000), (4, "y", 3001, 1)]


def test_tokens_are_counted_where_texts_are_cut(spark):
    """One process of Python a task, and no lists of ids that come back."""
    plan = catalog.queries()["tokenizer_truncation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array<int>" not in plan


def test_components_keep_the_partitions_of_their_shuffles(spark, monkeypatch):
    """Rounds are not squeezed into a few files."""
    told = []
    whole = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda *a, **b: told.append(b.get("parts")) or whole(*a, **b))
    edges = spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graph.connected_components(edges).collect()} == {0} and set(told) == {None}


def test_components_need_no_map_of_nodes_in_memory(spark, monkeypatch):
    """No round builds a hash table of a partition's nodes, which could not spill, and no round follows a chain node by node."""
    plans = []
    whole = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, *a, **b))
    chain = [(i, i + 1) for i in range(-40, 0)]
    star = [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 299) for i in range(50)]  # hubs of the smallest and the largest id
    rest = [(400, 401), (401, 400), (400, 401), (402, 402), (403, None)]
    edges = spark.createDataFrame(chain + star + rest, "src long, dst long")
    found = graph.connected_components(edges)
    told = {-40: 41, 100: 50, 200: 51, 400: 2}
    assert {r["component"]: r["count"] for r in found.groupBy("component").count().collect()} == told and found.select("node").distinct().count() == sum(told.values())
    assert plans and not any("HashJoin" in p for p in plans)
    assert len(plans) < 25 and graph.connected_components(edges.where("src > 401")).count() == 0
