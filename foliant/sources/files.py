"""File sources: splits, lookups, caches, numbered chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from foliant.operators.parsing import with_links
from foliant.storage import discard, materialize, shared_dir

SPLITS = ("train", "test", "annotated")


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet files of a folder, with a declared schema and only some columns on request."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, whole: bool = False, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines, or whole files that hold arrays of records."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("multiLine", whole).json(path)


def read_splits(spark: SparkSession, path: str, splits: Sequence[str], known: Sequence[str] = SPLITS) -> DataFrame:
    """Array-of-record files ``<split>.json`` as one table with a ``split`` column."""
    unknown = [s for s in splits if s not in known]
    if unknown:
        raise ValueError(f"unknown splits {unknown}")
    parts = [read_json(spark, f"{path}/{s}.json", whole=True).withColumn("split", F.lit(s)) for s in splits]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV lookup table with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def find(df: DataFrame, condition: str | None = None, without: Sequence[str] = (), limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows of a condition without some columns; a limit needs an order."""
    if limit is not None and not order:
        raise ValueError("a limit needs an order")
    out = (df.where(condition) if condition else df).drop(*without)
    return out.orderBy(*order).limit(limit) if limit is not None else out


def batches(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """Rows in lists of ``size``, fetched partition by partition; an empty table gives one empty list."""
    held: list[Row] = []
    any_row = False
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        any_row = True
        if len(held) == size:
            yield held
            held = []
    if held or not any_row:
        yield held


def numbered_chunks(df: DataFrame, rows: int, out: str = "chunk") -> DataFrame:
    """The table with the number of each row's chunk: consecutive chunks of ``rows`` rows, the last one maybe smaller.

    Rows are numbered by partition and place, what partitions hold is summed up before each of them, and the result
    is written in a folder a chunk, so that a chunk is read without the others.
    """
    spark = df.sparkSession
    placed = materialize(df.withColumn("_at", F.monotonically_increasing_id()), "chunks-placed")
    part = F.shiftright("_at", 33)
    held = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    held = held.select("_part", "_first", before.alias("_before"))
    numbered = placed.withColumn("_part", part).join(held, "_part").withColumn(out, F.floor((F.col("_before") + F.col("_at") - F.col("_first")) / rows).cast("int"))
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    numbered.select(*df.columns, out).repartition(out).write.partitionBy(out).parquet(path)
    discard(placed)
    found = spark.read.schema(StructType([*df.schema]).add(out, "integer")).parquet(path)
    found._foliant_path = path
    return found


def chunks(df: DataFrame, rows: int = 50_000) -> Iterator[DataFrame]:
    """The table as consecutive tables of ``rows`` rows, in the order of its files; each reads only its own folder."""
    numbered = numbered_chunks(df, rows, "_chunk")
    for at in range(-(-numbered.count() // rows)):
        yield df.sparkSession.read.schema(df.schema).parquet(f"{numbered._foliant_path}/_chunk={at}")


def stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet folder as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at ``path``, made and written first if it is missing or to be overwritten."""
    if not overwrite:
        try:
            return spark.read.parquet(path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def result_pages(pages: DataFrame, day: str, html: str, pattern: str = r"/doc/[A-Za-z0-9]+") -> tuple[DataFrame, DataFrame]:
    """Of fetched result pages of a search: ``day, ids`` by page, and ``day, n_reported`` as the pages tell it.

    A page that could not be fetched has null in place of its ids; ``reconciled`` compares both.
    """
    listed = with_links(pages, html, "ids", pattern).select(day, F.when(F.col(html).isNotNull(), F.col("ids")).alias("ids"))
    told = F.regexp_extract(F.coalesce(html, F.lit("")), r"Znaleziono\s+(\d+)\s+orzeczeń", 1).try_cast("int")
    return listed, pages.select(day, told.alias("n")).groupBy(day).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_reported"))


def incremental(df: DataFrame, updated: str, since: str | None) -> DataFrame:
    """Rows updated at or after the last run, oldest first; all rows on the first run."""
    rows = df if since is None else df.where(F.col(updated) >= F.lit(since).cast("timestamp"))
    return rows.orderBy(updated)


def reconciled(pages: DataFrame, reported: DataFrame, day: str, ids: str, count: str) -> DataFrame:
    """Per day: documents listed, documents reported, and whether they agree."""
    listed = pages.groupBy(day).agg(F.sum(F.coalesce(F.size(ids), F.lit(0))).alias("n_listed"))
    joined = reported.select(day, F.col(count).alias("n_reported")).join(listed, day, "left").na.fill(0, ["n_listed"])
    return joined.withColumn("agrees", F.col("n_listed") == F.col("n_reported"))
