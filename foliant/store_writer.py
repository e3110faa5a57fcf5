"""Writing objects to a store in two phases, through a data source of Spark's.

A task stages its objects and tells what it staged; when all tasks are done the staged objects are published,
and if the job fails they are dropped. A task that fails is run again, and what its failed attempt staged is
never published. Objects have deterministic ids, so writing them again replaces them. An object that the store
refuses fails by itself: its id and error are published beside the objects.

``FolderStore`` is a store in a folder of any file system: published objects are the files that its commits
name, and of an object that several commits hold the last one counts.

Defined cases: an object without id is refused; of objects with one id in a job one counts, the later one of its
task; nothing to write is a commit without files; a store without objects is an empty table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from foliant.shipping import ship_to_driver

ERRORS = pa.schema([("id", pa.string()), ("error", pa.string())])
#: Bytes of objects in a staged file.
FILE_BYTES = 32 << 20
#: Of a batch, for every row, what is wrong with it or None.
Refuse = Callable[[pa.RecordBatch], Sequence[str | None]]


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged."""

    files: list[str]
    errors: list[str]
    n_objects: int
    n_errors: int


@dataclass(frozen=True)
class FolderStore:
    """Objects in Parquet files below a folder, with commits that name the files."""

    path: str

    def _system(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path

    def stage(self, job: str, rows: pa.Table, kind: str) -> str:
        system, place = self._system()
        name = f"{kind}/{job}/{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{place}/{kind}/{job}", recursive=True)
        with system.open_output_stream(f"{place}/{name}") as out:
            pq.write_table(rows, out, compression="zstd")
        return name

    def publish(self, job: str, staged: Sequence[Staged]) -> None:
        """One file makes all of a job's objects visible at once."""
        system, place = self._system()
        system.create_dir(f"{place}/commits", recursive=True)
        told = {"job": job, "files": [f for s in staged for f in s.files], "errors": [f for s in staged for f in s.errors], "n_objects": sum(s.n_objects for s in staged), "n_errors": sum(s.n_errors for s in staged)}
        known = len([f for f in system.get_file_info(pafs.FileSelector(f"{place}/commits")) if f.is_file])
        with system.open_output_stream(f"{place}/commits/{known:08d}-{job}.json") as out:
            out.write((json.dumps(told | {"number": known}) + "\n").encode())
        self._sweep(job, {*told["files"], *told["errors"]})

    def drop(self, job: str) -> None:
        self._sweep(job, set())

    def _sweep(self, job: str, keep: set[str]) -> None:
        """Delete what a job staged and did not publish."""
        system, place = self._system()
        for kind in ("objects", "errors"):
            for found in system.get_file_info(pafs.FileSelector(f"{place}/{kind}/{job}", allow_not_found=True)):
                if f"{kind}/{job}/{found.base_name}" not in keep:
                    system.delete_file(found.path)

    def _rows(self, spark: SparkSession, which: str, schema: StructType) -> DataFrame:
        """Rows of the files that commits name, with the commit's number. Other files are not taken up."""
        system, place = self._system()
        if system.get_file_info(f"{place}/{which}").type == pafs.FileType.NotFound:
            return spark.createDataFrame([], StructType([*schema]).add("number", "long"))
        commits = spark.read.schema("number long, files array<string>, errors array<string>").json(f"{self.path}/commits")
        named = commits.select("number", F.explode("files" if which == "objects" else "errors").alias("f")).select("number", F.element_at(F.split("f", "/"), -1).alias("_file"))
        rows = spark.read.schema(schema).parquet(f"{self.path}/{which}/*")
        return rows.withColumn("_file", F.col("_metadata.file_name")).join(named, "_file").drop("_file")

    def read(self, spark: SparkSession, schema: StructType | str, key: str = "id") -> DataFrame:
        """Every object once, as last written."""
        kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        rows = self._rows(spark, "objects", StructType([*kinds]).add("_order", "long"))
        last = Window.partitionBy(key).orderBy(F.desc("number"), F.desc("_order"))
        return rows.withColumn("_at", F.row_number().over(last)).where("_at = 1").select(*kinds.names)

    def refused(self, spark: SparkSession) -> DataFrame:
        """``number, id, error`` of the objects that were refused."""
        return self._rows(spark, "errors", StructType.fromDDL("id string, error string")).select("number", "id", "error")


class _Writer(DataSourceArrowWriter):
    def __init__(self, store: FolderStore, key: str, refuse: Refuse | None):
        self.store, self.key, self.refuse, self.job = store, key, refuse, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        done, held, size, order = Staged([], [], 0, 0), [], 0, 0
        for batch in iterator:
            wrong = list(self.refuse(batch)) if self.refuse else [None] * batch.num_rows
            ids = batch.column(self.key).to_pylist()
            wrong = ["no id" if i is None else w for i, w in zip(ids, wrong)]
            good = batch.filter(pa.array([w is None for w in wrong], pa.bool_()))
            if good.num_rows:
                held.append(pa.Table.from_batches([good]).append_column("_order", pa.array(range(order, order + good.num_rows), pa.int64())))
                size, order = size + good.nbytes, order + good.num_rows
            bad = [(None if i is None else str(i), w) for i, w in zip(ids, wrong) if w is not None]
            if bad:
                done.errors.append(self.store.stage(self.job, pa.table([pa.array(c, pa.string()) for c in zip(*bad)], schema=ERRORS), "errors"))
                done.n_errors += len(bad)
            if size > FILE_BYTES:
                done.files.append(self.store.stage(self.job, pa.concat_tables(held), "objects"))
                held, size = [], 0
        if held:
            done.files.append(self.store.stage(self.job, pa.concat_tables(held), "objects"))
        done.n_objects = order
        return done

    def commit(self, messages: list[Staged | None]) -> None:
        self.store.publish(self.job, [m for m in messages if m is not None])

    def abort(self, messages: list[Staged | None]) -> None:
        self.store.drop(self.job)


def write_objects(df: DataFrame, store: FolderStore, key: str = "id", refuse: Refuse | None = None) -> None:
    """Write rows as objects of a store; all that are not refused become visible at once, or none."""
    ship_to_driver(df.sparkSession)
    kinds = df.schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "foliant_objects"

        def schema(self) -> StructType:
            return kinds

        def writer(self, schema: StructType, overwrite: bool) -> _Writer:
            return _Writer(store, key, refuse)

    df.sparkSession.dataSource.register(Source)
    df.write.format("foliant_objects").mode("append").save()
