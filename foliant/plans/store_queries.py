"""Queries of the keyed table and of services: changes over generations, incremental pull, scraping, pushdown, writers."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from foliant.functions.ids import sha_uuid
from foliant.merge_table import MergeTable
from foliant.operators import adjacency as A, graph as G, quantised as Q
from foliant.plans.registering import registrar, scratch
from foliant.sources import scraping, services, table
from foliant.storage import parts_of
from foliant.store_writer import FolderStore, write_objects

QUERIES, query = registrar()


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'back' WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'segment ' || c_nationkey ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance FROM customer WHERE c_custkey % 7 <> 2
  UNION ALL SELECT c_custkey + 10000000, c_name, 'new', c_acctbal FROM customer WHERE c_nationkey = 3""")
def merged_customers(spark, sf_dir):
    """Rows over eight generations: fields changed, rows deleted, some of them back, new rows inserted, compacted on the way."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), "c_nationkey")
    store = MergeTable(spark, scratch(spark, "merged"), "key", "key long, name string, segment string, balance double")
    store.upsert(c)
    store.upsert(c.where("key % 3 = 0").select("key", F.upper("name").alias("name")))
    store.delete(c.where("key % 5 = 0 or key % 7 = 2"))
    store.compact(2)
    store.upsert(c.select("key", F.when(F.col("key") % 4 == 0, F.concat(F.lit("segment "), "c_nationkey")).alias("segment")).where("key % 5 <> 0 and key % 7 <> 2"), present={"segment": F.col("segment").isNotNull()})
    store.upsert(c.where("key % 5 = 0 and key % 7 <> 2").select("key", F.lit("back").alias("name")))
    store.insert(c.where("key % 7 <> 2").select("key", F.lit("not taken").alias("name")))
    store.insert(c.where("c_nationkey = 3").select((F.col("key") + 10_000_000).alias("key"), "name", F.lit("new").alias("segment"), "balance"))
    store.compact(3)
    return store.read()


_CHANGES = """WITH c AS (SELECT * FROM client_changes WHERE client_id IS NOT NULL AND op IN ('I', 'U', 'D')),
k AS (SELECT *, seq * 1000000000 + change_id AS w, max(CASE WHEN op = 'D' THEN seq * 1000000000 + change_id END) OVER (PARTITION BY client_id) AS gone FROM c),
l AS (SELECT client_id, {fields} FROM k WHERE op <> 'D' AND (gone IS NULL OR w > gone) GROUP BY client_id)"""


@query(_CHANGES.format(fields="arg_max(segment, w) FILTER (segment IS NOT NULL) AS segment, arg_max(city, w) FILTER (city IS NOT NULL) AS city, arg_max(balance, w) FILTER (balance IS NOT NULL) AS balance, max(w) AS w") + " SELECT client_id, segment, city, balance FROM l")
def client_states(spark, sf_dir):
    """Clients after all their changes, which arrive late and out of order: a generation a month, by the changes' own order."""
    changes = table(spark, sf_dir, "client_changes").where("client_id is not null and op in ('I', 'U', 'D')").withColumn("at", F.col("seq") * 1_000_000_000 + F.col("change_id"))
    store = MergeTable(spark, scratch(spark, "clients"), "client_id", "client_id long, segment string, city string, balance double")
    given = {f: F.col(f).isNotNull() for f in ("segment", "city", "balance")}
    for part in range(3):  # the last third first
        batch = changes.where(F.pmod(F.col("change_id"), F.lit(3)) == 2 - part)
        last = store.apply(batch, F.col("op") == "D", present=given, order="at", token=f"part {part}")
        if store.apply(batch, F.col("op") == "D", present=given, order="at", token=f"part {part}") is not None:  # a replay
            raise ValueError(f"generation {last} was written twice")
        store.compact(1)
    return store.read()


# services


class _Hesitant(services.ServedTable):
    """A service whose every page fails when it is first asked for."""

    def page(self, after, last_key, until, limit, columns, attempt=1):
        if attempt == 1:
            raise TimeoutError("ask again")
        return super().page(after, last_key, until, limit, columns, attempt)


@query("""SELECT o_orderkey AS id, o_totalprice AS price, 'first' AS version FROM orders
  UNION ALL SELECT o_orderkey, o_totalprice * 2, 'update' FROM orders WHERE o_orderkey % 3 = 0""")
def paged_service(spark, sf_dir):
    """Orders pulled by time of update from a service that lists them by pages: all of them, then those that were updated since."""
    path = scratch(spark, "service")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit("first").alias("version"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated"))
    late = F.lit("2030-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.pmod(F.col("id"), F.lit(1000)).cast("int"))
    updates = orders.where("id % 3 = 0").select("id", (F.col("price") * 2).alias("price"), F.lit("update").alias("version"), late.alias("updated"))
    states = (orders, orders.where("id % 3 <> 0").unionByName(updates), None)
    for at, state in enumerate(states):  # the third run finds nothing new
        if state is not None:
            served = state.repartitionByRange(parts_of(state) or 8, "updated", "id").sortWithinPartitions("updated", "id")
            served.write.option("parquet.block.size", 1 << 20).mode("overwrite").parquet(f"{path}/served")  # a page reads a row group or two
        stream = services.pull(spark, f"orders_{at}_{path[-32:]}", _Hesitant(f"{path}/served", "updated", "id"), "id long, price double, version string, updated timestamp_ntz", size=5000, wait=0.0)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "price", "version")


class _Shelf(services.ServedTable):
    """Contents by key: a third is not there, some come when they are asked for again, some never do."""

    def content(self, key, attempt):
        if key % 3 == 0:
            return None
        if key % 11 == 5:
            raise OSError("out of reach")
        if key % 4 == 1 and attempt == 1:
            raise TimeoutError("ask again")
        rows = self.column_at(key, self.key, "html")
        at = pc.index(rows.column(self.key), key).as_py()
        return rows.column("html")[at].as_py() if at >= 0 else None


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 11 <> 5 THEN length(html) END::INT AS n, CASE WHEN page_id % 3 <> 0 AND page_id % 11 = 5 THEN 'out of reach' END AS error FROM pages")
def fetched_content(spark, sf_dir):
    """Items with what a service has for them, asked for with patience; errors are kept, not found gives null."""
    path = scratch(spark, "shelf")
    pages = table(spark, sf_dir, "pages")
    pages.select("page_id", "html").repartitionByRange(8, "page_id").sortWithinPartitions("page_id").write.option("parquet.block.size", 1 << 20).parquet(path)  # a look-up reads a row group
    found = services.with_content(pages.select("page_id"), "page_id", _Shelf(path, "page_id", "page_id").content, attempts=2, wait=0.0)
    return found.select("page_id", F.length("content").alias("n"), "error")


class _OddSite(scraping.ServedSite):
    """Some pages fail once, some always, some until the second round; some days report too many documents at first."""

    def reported(self, day, attempt, round_):
        n = super().reported(day, attempt, round_)
        return n + 2 if day.endswith("7") and round_ == 0 else n

    def listed(self, day, page, attempt, round_):
        if day.endswith("1") and attempt == 1:
            raise TimeoutError("slow")
        if day.endswith("4") and page == 0 or day.endswith("8") and round_ == 0:
            raise OSError("page is dead")
        return super().listed(day, page, attempt, round_)


@query("""WITH d AS (SELECT 'day' || (page_id % 20) AS day, count(*) AS n FROM pages GROUP BY 1)
SELECT day, n AS n_reported, CASE WHEN day LIKE '%4' THEN n - least(n, 10) ELSE n END AS n_listed, CASE WHEN day LIKE '%4' THEN 1 ELSE 0 END AS n_dead, day NOT LIKE '%4' AS settled FROM d""")
def scraped_site(spark, sf_dir):
    """Pages of a site by day: planned from what it reports, fetched with patience, planned again where that does not agree."""
    path = scratch(spark, "site")
    listed = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("day"), F.pmod(F.col("page_id"), F.lit(20))).alias("day"))
    listed.repartitionByRange(4, "day").sortWithinPartitions("day").write.parquet(path)
    _, days = scraping.scrape(listed.select("day").distinct(), _OddSite(services.ServedTable(path, "day", "page_id")), scraping.Patience(10, 2, 0.0))
    return days.select("day", "n_reported", "n_listed", F.col("n_dead").cast("int").alias("n_dead"), "settled")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_id >= 2000 AND event_id < 5000 AND event_type IN ('click', 'view') AND user_id % 2 = 0 GROUP BY 1")
def pushed_filters(spark, sf_dir):
    """Events from a Python source that takes the filters it can: files and row groups that cannot match stay closed."""
    path = scratch(spark, "pushed")
    table(spark, sf_dir, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    rows = services.filtered(spark, f"events_{path[-32:]}", services.ServedTable(path, "ts", "event_id"), "event_id long, user_id long, event_type string, value double", "event_id >= 2000 and event_id < 5000 and event_type in ('click', 'view') and user_id % 2 = 0")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _without_text(batch: pa.RecordBatch) -> list[str | None]:
    return [None if n else "no text" for n in batch.column("n_chars").to_pylist()]


@query("""SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version, NULL AS error FROM documents WHERE coalesce(n_chars, 0) > 0
  UNION ALL SELECT doc_id, NULL, NULL, NULL, 'no text' FROM documents WHERE coalesce(n_chars, 0) = 0""")
def written_objects(spark, sf_dir):
    """Objects written to a store in two phases, some of them again, and what the store refused."""
    store = FolderStore(scratch(spark, "objects"))
    docs = table(spark, sf_dir, "documents").select(sha_uuid(F.col("doc_id")).alias("id"), "doc_id", "lang", "n_chars", F.lit(1).alias("version"))
    write_objects(docs, store, refuse=_without_text)
    write_objects(docs.where("doc_id % 2 = 0 and n_chars > 0").withColumn("version", F.lit(2)), store, refuse=_without_text)
    good = store.read(spark, "id string, doc_id long, lang string, n_chars long, version int").select("doc_id", "lang", "n_chars", "version", F.lit(None).cast("string").alias("error"))
    refused = store.refused(spark).join(docs, "id").select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("int").alias("version"), "error")
    return good.unionByName(refused)


# vectors


@query(None)
def quantised_search(spark, sf_dir):
    """The ten nearest by cosine of every vector whose id 20 divides, from codes of an eighth of the bytes, candidates compared exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    return Q.search(Q.build_index(vectors), vectors, vectors.where("vec_id % 20 = 0"), 10).select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "distance")


# tensors


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), l AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS i FROM (SELECT DISTINCT l_orderkey FROM e) a),
  r AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS i FROM (SELECT DISTINCT l_partkey FROM e) b)
  SELECT l.i AS source, r.i AS target FROM e JOIN l ON l.l_orderkey = e.l_orderkey JOIN r ON r.l_partkey = e.l_partkey""")
def adjacency_round_trip(spark, sf_dir):
    """The whole graph of orders and parts as compressed adjacency by ranges, and its edges read back from it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("judgment"), F.col("l_partkey").cast("long").alias("base")).distinct()
    edges = G.edge_index(lines, "judgment", "base")[0]
    n = edges.agg(F.max(F.greatest("left_index", "right_index"))).first()[0] + 1
    return A.edges_of(A.compressed(edges, n, "left_index", "right_index", nodes=4096, most=10_000))


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM customer GROUP BY c_custkey // 7) t GROUP BY size")
def community_sizes(spark, sf_dir):
    """Sizes of the communities of all customers, planted as groups of seven who know the next three of their group, at resolution 3.

    A customer who knows nobody, as the only one of the last group, is a community too.
    """
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"))
    known = k.select("u", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i")).select("u", (F.col("u") + F.col("i")).alias("v")).where("floor(u / 7) = floor(v / 7)")
    edges = known.join(k.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    return G.community_sizes(G.with_lone_nodes(G.leiden(edges, "u", "v", resolution=3.0), k, "u"))
