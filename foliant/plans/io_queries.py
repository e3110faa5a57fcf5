"""Sources, sinks and streams by round trip: what is written to shared storage is read back and compared."""

from __future__ import annotations

import json

from pyspark.sql import Window, functions as F

from foliant import sinks
from foliant.operators import chunking as C, relational as R
from foliant.operators.validation import IngestSettings
from foliant.plans.registering import registrar, scratch
from foliant.sources import files, table
from foliant.streaming import ingest as I, keyed

QUERIES, query = registrar()


# sources


@query("SELECT c_custkey, c_name, NULL::INT AS missing FROM customer")
def scan_with_schema(spark, sf_dir):
    """A declared schema: only these columns are read, and one that the files lack is null."""
    return files.read_parquet(spark, f"{sf_dir}/customer.parquet", "c_custkey long, c_name string, missing int")


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def scan_of_shards(spark, sf_dir):
    """All shards that a glob names, as one table with pruned columns."""
    path = scratch(spark, "shards")
    for at, (name, key, text) in enumerate((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))):
        table(spark, sf_dir, name).select(F.col(key).alias("key"), F.col(text).alias("name"), F.lit(at).alias("more")).write.parquet(f"{path}/data/shard-{at}")
    return files.read_parquet(spark, f"{path}/data/shard-*", columns=["key", "name"])


@query("SELECT 'train' AS split, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'test', r_regionkey, r_name FROM region")
def json_splits(spark, sf_dir):
    """Array-of-record files by split."""
    path = scratch(spark, "splits")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    sinks.write_json(nation, f"{path}/train.json")
    sinks.write_json(region, f"{path}/test.json")
    return files.read_splits(spark, path, ["train", "test"]).select("split", F.col("key").cast("int").alias("key"), "name")


@query("SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def json_lines(spark, sf_dir):
    """JSON lines there and back, nulls included."""
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")), path)
    return files.read_json(spark, path, schema="event_id long, event_type string, value double")


@query("SELECT c_custkey, n_name AS nation, CASE WHEN c_nationkey < 20 THEN r_name END AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def csv_lookup(spark, sf_dir):
    """A CSV lookup table by a key of two columns; misses give nulls."""
    path = scratch(spark, "lookup")
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey < 20")
    names.select("n_nationkey", "n_name", "r_name").coalesce(1).write.option("header", True).csv(path)
    lookup = files.read_lookup(spark, path, "c_nationkey int, nation string, region string")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")), "c_nationkey")
    return R.lookup(customers, lookup, ["c_nationkey", "nation"]).select("c_custkey", "nation", "region")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25 ORDER BY p_size DESC, p_partkey LIMIT 50")
def find_rows(spark, sf_dir):
    """Rows of a condition without some columns, in order, up to a limit."""
    return files.find(table(spark, sf_dir, "part"), "p_size > 25", without=["p_brand", "p_type", "p_retailprice"], limit=50, order=[F.desc("p_size"), "p_partkey"])


@query("SELECT least(700, n - i * 700)::INT AS n_rows, 1::BIGINT AS dummy FROM (SELECT count(*) AS n FROM part) c, unnest(range((n + 699) // 700)) r(i)")
def row_batches(spark, sf_dir):
    """Sizes of consecutive batches of rows, which stay on the executors."""
    batches = files.numbered_chunks(table(spark, sf_dir, "part").select("p_partkey"), 700, "batch")
    return batches.groupBy("batch").agg(F.count(F.lit(1)).cast("int").alias("n_rows")).select("n_rows", F.lit(1).cast("long").alias("dummy"))


@query("SELECT i AS place, least(400, n - i * 400)::BIGINT AS n_rows, n AS n_distinct FROM (SELECT count(*) AS n FROM part) c, unnest(range((n + 399) // 400)) r(i)")
def table_chunks(spark, sf_dir):
    """A table as consecutive tables of 400 rows."""
    parts = files.numbered_chunks(table(spark, sf_dir, "part").select("p_partkey"), 400, "place")
    counts = parts.groupBy(F.col("place").cast("long").alias("place")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(parts.agg(F.count_distinct("p_partkey").alias("n_distinct")), F.lit(True))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' ORDER BY o_orderdate")
def incremental_rows(spark, sf_dir):
    return files.incremental(table(spark, sf_dir, "orders"), "o_orderdate", "1997-06-01").select("o_orderkey")


@query("SELECT 2 AS n_reads, 1 AS n_made, count(*) AS n FROM supplier")
def cached_table(spark, sf_dir):
    """A table that is made once and then read."""
    path, made = scratch(spark, "cache"), []
    make = lambda: made.append(1) or table(spark, sf_dir, "supplier")
    reads = [files.cached(spark, path, make) for _ in range(2)]
    return reads[-1].agg(F.lit(len(reads)).alias("n_reads"), F.lit(len(made)).alias("n_made"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(md5(doc_id::VARCHAR || '#17'), 1, 13))::BIGINT < (0.2 * 4503599627370496)::BIGINT")
def fractional_sample(spark, sf_dir):
    """A sampling operator: a fifth of the rows by seeded hash."""
    return R.fraction(table(spark, sf_dir, "documents"), 0.2, "doc_id", 17).select("doc_id")


# sinks


@query("SELECT p_partkey, p_name, ((SELECT count(*) FROM part) + 299) // 300 AS n_files FROM part")
def named_shards(spark, sf_dir):
    """Shards under names that tell their number."""
    path = scratch(spark, "named")
    names = sinks.write_named_shards(table(spark, sf_dir, "part").select("p_partkey", "p_name"), path, "part", 300)
    if names != [f"part_{i:02d}_of_{len(names):02d}.parquet" for i in range(len(names))]:
        raise ValueError(names)
    return spark.read.parquet(*[f"{path}/{n}" for n in names]).withColumn("n_files", F.lit(len(names)).cast("long"))


@query("SELECT count(*) AS n, 4::BIGINT AS n_files FROM part")
def fixed_files(spark, sf_dir):
    path = scratch(spark, "files")
    sinks.write_files(table(spark, sf_dir, "part"), path, 4)
    per = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))


@query("SELECT ceil(count(*) / 250.0)::BIGINT AS least_files, count(*) AS n FROM part")
def bounded_shards(spark, sf_dir):
    """No file has more rows than a shard may have."""
    path = scratch(spark, "bounded")
    sinks.write_shards(table(spark, sf_dir, "part").coalesce(1), path, 250)
    per = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") <= 250).alias("least_files"), F.sum("n").alias("n"))


@query("SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def joined_sink(spark, sf_dir):
    path = scratch(spark, "joined")
    sinks.write_joined(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), ["doc_id"], path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 1")
def updated_by_function(spark, sf_dir):
    """An update function over some stored rows, and rows deleted by key."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    mark = lambda rows: rows.select("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("c_mktsegment"))
    new = R.updated_by(stored, mark, "c_custkey", F.col("c_nationkey") == 3)
    return R.without(new, stored.where("c_custkey % 4 = 1"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey AS key, c_name AS name, NULL AS note FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, min(c_name || '*'), 'new' FROM customer WHERE c_custkey % 2 = 1 GROUP BY c_custkey")
def inserted_rows(spark, sf_dir):
    """New rows beside stored ones; keys that are stored stay as they are, absent fields are null."""
    c = table(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("note"))
    new = c.select(F.col("c_custkey").alias("key"), F.concat("c_name", F.lit("*")).alias("name"), F.lit("new").alias("note"))
    return R.inserted(stored, new.unionByName(new.withColumn("name", F.concat("name", F.lit("z")))), "key")


_UUID = "lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12))"


@query(f"SELECT vec_id, {_UUID} AS uuid, CASE WHEN label % 2 = 0 THEN NULL ELSE 'x' END AS name, label, embedding[1]::DOUBLE AS base, 64::INT AS n_fast FROM (SELECT *, sha256(vec_id::VARCHAR) AS h FROM embeddings) e")
def document_objects(spark, sf_dir):
    """Objects of a store: a deterministic id, empty texts as null, vectors by name."""
    rows = table(spark, sf_dir, "embeddings").withColumn("name", F.when(F.col("label") % 2 == 0, "").otherwise("x"))
    objects = sinks.document_objects(rows, "vec_id", ["name", "label"], {"base": "embedding", "fast": "embedding"})
    return objects.select("vec_id", "uuid", "name", "label", F.col("vectors.base")[0].cast("double").alias("base"), F.size("vectors.fast").alias("n_fast"))


@query(f"""SELECT doc_id, chunk_id, {_UUID} AS uuid, lang, source, 'content' AS segment_type, 1.0::DOUBLE AS confidence_score, doc_id AS parent_segment_id FROM (SELECT doc_id, chunk_id, sha256(doc_id::VARCHAR || CASE WHEN chunk_id = 0 THEN '' ELSE '_' || chunk_id END) AS h, lang, source FROM (
  SELECT doc_id, lang, source, (unnest(range(1, greatest(1, ceil((length(text) - 112) / 400.0))::INT + 1)) - 1)::INT AS chunk_id FROM documents WHERE length(text) > 0) c) d""")
def chunk_objects(spark, sf_dir):
    """Chunks with the attributes of their documents, as objects of a store."""
    docs = table(spark, sf_dir, "documents")
    chunks = C.with_attributes(C.fixed_chunks(docs, 512, 112), docs, ["lang", "source"], "doc_id")
    return sinks.chunk_objects(chunks, "doc_id").select("doc_id", "chunk_id", "uuid", "lang", "source", "segment_type", F.col("confidence_score").cast("double").alias("confidence_score"), "parent_segment_id")


@query("SELECT 'json' AS form, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'yaml', n_nationkey, n_name FROM nation")
def json_and_yaml(spark, sf_dir):
    """A small table as one indented JSON array and as YAML, read again."""
    path = scratch(spark, "records")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sinks.write_json(rows, f"{path}/json")
    sinks.write_yaml(rows, f"{path}/yaml")
    told = spark.read.text(f"{path}/json", wholetext=True)
    first = told.select(F.lit("json").alias("form"), F.inline(F.from_json("value", "array<struct<n_nationkey:int,n_name:string>>")))
    items = spark.read.text(f"{path}/yaml", wholetext=True).select(F.explode(F.split("value", r"(?:^|\n)-\n")).alias("t")).where("t like '%n_name%'")
    second = items.select(F.lit("yaml").alias("form"), F.regexp_extract("t", r"n_nationkey: (\d+)", 1).try_cast("int").alias("n_nationkey"), F.trim(F.regexp_replace(F.regexp_extract("t", r"n_name: (.*)", 1), '"', "")).alias("n_name"))
    return first.unionByName(second).toDF("form", "key", "name")


@query("SELECT o_orderstatus AS split, count(*) AS n, count(*) AS told FROM orders GROUP BY 1")
def exported_splits(spark, sf_dir):
    """JSON lines by split, and the sizes that are written beside them."""
    path = scratch(spark, "export")
    sinks.write_splits(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), path)
    told = spark.read.text(f"{path}/dataset_info").select(F.explode(F.from_json(F.get_json_object("value", "$.splits"), "map<string,long>")).alias("split", "told"))
    return spark.read.json(f"{path}/data").groupBy("split").agg(F.count("*").alias("n")).join(told, "split")


@query("SELECT r_regionkey AS key, '| ' || r_regionkey || ' | ' || r_name || ' |' AS markdown, r_regionkey || ' & ' || r_name || ' \\\\' AS latex FROM region")
def text_tables(spark, sf_dir):
    """A small result as Markdown and as LaTeX, line by line."""
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey")
    marked, set_ = sinks.markdown_table(rows).split("\n")[2:], sinks.latex_table(rows).split("\n")[4:-2]
    return spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate(zip(marked, set_))], "key int, markdown string, latex string")


@query("SELECT 'node' AS kind, n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT 'link', n_nationkey, n_regionkey::VARCHAR FROM nation UNION ALL SELECT 'node', 1000 + r_regionkey, r_name FROM region")
def node_link_graph(spark, sf_dir):
    """Nodes and edges as Parquet and as lines of node-link JSON."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(region.select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name")))
    edges = nation.select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("v"))
    path = scratch(spark, "graph")
    sinks.write_graph(nodes, edges, path)
    lines = sinks.node_link(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), "id", "u", "v")
    whole = sinks.node_link_object(nodes, edges, "id", "u", "v")
    if len(whole["nodes"]) != nodes.count() or len(whole["links"]) != edges.count():
        raise ValueError(json.dumps(whole)[:200])
    get = lambda path: F.get_json_object("item", path)
    return lines.select("kind", F.coalesce(get("$.id"), get("$.source")).cast("int").alias("a"), F.coalesce(get("$.name"), get("$.target")).alias("b"))


# streams


def _failing_split(text: str) -> list[str]:
    if "Brand#1" in text:
        raise ValueError("no chunks of brand one")
    return text.split("|")


#: Shards of documents: of large tables, some thousand documents with short texts in each.
_SHARDS = 1 << 12

_taken_up: dict[tuple[str, str], str] = {}


def _ingested(spark, sf_dir) -> str:
    """Parts taken up in three runs: one half, the other half with repeats, and nothing new; once for all queries."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known in _taken_up:
        return _taken_up[known]
    path = scratch(spark, "ingest")
    text = F.when(F.col("p_partkey") % 10 != 0, F.concat("p_name", F.lit("|"), "p_brand", F.lit("|"), "p_type"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), F.col("p_size").alias("size"))
    schema = "id long, text string, size int"
    settings = IngestSettings(chunk_size=100, overlap=0)
    halves = (parts.where("id % 2 = 0"), parts.unionByName(parts.where("id % 3 = 0")), parts.limit(0))
    for at, half in enumerate(halves):
        half.coalesce(1).write.mode("append").parquet(f"{path}/in")
        I.ingest(spark, f"{path}/in", schema, f"{path}/out", f"{path}/checkpoint", settings, key="id", text="text", attributes=["size"], split=_failing_split, shards=_SHARDS)
    _taken_up[known] = f"{path}/out"
    return _taken_up[known]


_BAD = "(p_partkey % 10 = 0 OR contains(p_brand, 'Brand#1'))"


@query(f"SELECT p_partkey::VARCHAR AS document_id, NOT {_BAD} AS success, CASE WHEN {_BAD} THEN 0 ELSE 3 END::INT AS chunks_count, CASE WHEN p_partkey % 10 = 0 THEN 'no text' WHEN {_BAD} THEN 'no chunks of brand one' END AS error_message FROM part")
def ingestion_tracker(spark, sf_dir):
    """A stream that is resumed: every document once, failures by themselves, failed ones tried again."""
    return I.tracker(spark, _ingested(spark, sf_dir)).select("document_id", "success", "chunks_count", "error_message")


@query(f"SELECT p_partkey::VARCHAR AS document_id, i::INT AS chunk_id, [p_name, p_brand, p_type][(i + 1)::INT] AS chunk_text, p_size AS size FROM part, range(3) r(i) WHERE NOT {_BAD}")
def ingestion_chunks(spark, sf_dir):
    """Chunks with the attributes of their documents; a replay adds nothing."""
    return I.chunks(spark, _ingested(spark, sf_dir), "size int").select("document_id", "chunk_id", "chunk_text", "size")


@query(f"SELECT CASE WHEN p_partkey % 10 = 0 THEN 'no text' ELSE 'no chunks of' END AS kind, count(*) AS n FROM part WHERE {_BAD} GROUP BY 1")
def ingestion_dead_letters(spark, sf_dir):
    return I.dead_letters(spark, _ingested(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT count(*) AS n, count(*) FILTER ({_BAD}) AS f FROM part WHERE p_partkey % 2 = 0), b AS (SELECT count(*) FILTER (p_partkey % 2 = 1) AS n, count(*) FILTER (p_partkey % 2 = 1 AND {_BAD}) AS f FROM part)
  SELECT a.n AS first, a.f AS first_failed, 3 * (a.n - a.f) AS first_chunks, b.n + a.f AS second, b.f + a.f AS second_failed, a.n + b.n + a.f AS so_far FROM a, b""")
def ingestion_progress(spark, sf_dir):
    """Counters of the first two batches that took something up."""
    rows = I.progress(spark, _ingested(spark, sf_dir)).where("n_documents > 0").orderBy("batch_id").limit(2).withColumn("at", F.row_number().over(Window.orderBy("batch_id")))  # two rows
    pick = lambda c, at, name: F.max(F.when(F.col("at") == at, F.col(c))).alias(name)
    return rows.agg(pick("n_documents", 1, "first"), pick("n_failed", 1, "first_failed"), pick("n_chunks", 1, "first_chunks"), pick("n_documents", 2, "second"), pick("n_failed", 2, "second_failed"), F.sum("n_documents").alias("so_far"))


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT {_BAD}) AS successful, count(*) FILTER ({_BAD}) AS failed, (3 * count(*) FILTER (NOT {_BAD}))::BIGINT AS chunks, count(*) FILTER (NOT contains(p_partkey::VARCHAR, '1')) AS kept FROM part")
def ingestion_stats(spark, sf_dir):
    """Tracker statistics, and the rows that stay when documents of a pattern are reset."""
    rows = I.tracker(spark, _ingested(spark, sf_dir))
    return I.tracker_stats(rows).join(I.without_matching(rows, "1").agg(F.count("*").alias("kept")), F.lit(True))


def _unsteady(text: str, attempt: int) -> list[str]:
    """Chunks of a sale; some sales fail once, some always."""
    number = int(text.split("|")[0])
    if number % 50 == 0 or number % 5 == 0 and attempt == 1:
        raise TimeoutError("the service took too long")
    return text.split("|")


@query("""SELECT sale_id::VARCHAR AS document_id, CASE WHEN sale_id % 50 = 0 THEN 3 WHEN sale_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS n_attempts, sale_id % 50 <> 0 AS success, sale_id % 50 = 0 AS dead,
  CASE WHEN sale_id % 50 = 0 THEN 'the service took too long' END AS error_message FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL) s""")
def ingestion_retries(spark, sf_dir):
    """Sales taken up as they arrive, in two runs: those that fail for the moment are tried again by timers, up to three times.

    Two more runs with a later arrival, which is left out, let the last timers pass.
    """
    path = scratch(spark, "retries")
    sales = table(spark, sf_dir, "sales").select(F.col("sale_id").cast("string").alias("id"), F.concat_ws("|", "sale_id", "status", "priority").alias("text"), F.coalesce("arrived_at", F.lit("2024-01-01").cast("timestamp_ntz")).alias("arrived"))
    later = lambda day: spark.range(1).select(F.lit("end").alias("id"), F.lit("1|end").alias("text"), F.lit(f"2030-01-0{day}").cast("timestamp_ntz").alias("arrived"))
    half = F.lit("2024-03-01").cast("timestamp_ntz")
    for part in (sales.where(F.col("arrived") < half), sales.where(F.col("arrived") >= half), later(1), later(2)):
        part.write.mode("append").parquet(f"{path}/in")
        stream = files.stream(spark, f"{path}/in", "id string, text string, arrived timestamp_ntz", files_per_batch=1_000_000)  # a run is a batch
        keyed.ingest_keyed(stream, f"{path}/out", f"{path}/checkpoint", "id", "text", _unsteady, arrived="arrived", late="1 day", retry=keyed.Retry(3, 60_000), shards=_SHARDS)
    return keyed.keyed_tracker(spark, f"{path}/out").where("document_id <> 'end'").select("document_id", "n_attempts", "success", "dead", "error_message")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, sf_dir):
    """Event-time counts of a stream that is bounded by its files."""
    path = scratch(spark, "windows")
    events = files.stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = I.windowed_counts(events, "ts", "event_type")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/counts")  # noqa: E731  all windows of every batch
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/counts").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
