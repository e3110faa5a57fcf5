"""A keyed table that is merged when it is read.

A change is a small write of its own: rows with the fields that they supply, or tombstones, below the number of
their generation and the bucket of their key. A read takes, for every key, the last value of every field, in one
aggregation that combines before it shuffles. Buckets that one compaction has left alone since are read as they
are. Compaction writes the merged rows of buckets as a new generation; generations before it stay until they are
vacuumed, so older readers finish and an earlier state can be read.

A commit is one small file that names the folder of its rows, created only if its number is still free, so of two
writers one fails and tries again. Folders without a commit are not read.
A commit may carry a token; a token that is committed already makes the write nothing, so a replayed batch changes
nothing.

Changes are ordered by an order column where one is given, so that late changes find their place, and by
generation. Every value keeps its own place in that order, through compaction too, and deletions stay as
tombstones, so a change that comes late changes only what was older than itself.

Defined cases: a null key is an error in the written rows' task; of several changes of a key in one write those
with the greatest order count last, equal ones by their fields' values; deleted keys that were never there are
no error; a table without commits is empty; fields that a row does not supply keep their value, and are null in a
new row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Buckets of a table unless it is made with more.
BUCKETS = 16
_META = ("_folder", "_gen", "_drop", "_has")
_ORDERS = "map<string, struct<at:long, gen:int>>"
#: The name under which the order of a whole row is kept.
_ROW = ""


class Conflict(RuntimeError):
    """Another writer has taken the generation."""


@dataclass(frozen=True)
class Commit:
    """A generation: whether it holds merged rows or changes, which buckets it has, and its writer's token."""

    generation: int
    merged: bool
    buckets: tuple[int, ...]
    folder: str
    token: str | None = None


class MergeTable:
    """A table in a folder, with rows named by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.fields = [f.name for f in self.schema if f.name != key]
        if clash := {n.lower() for n in self.schema.names} & {*_META, "_bucket"}:
            raise ValueError(f"reserved names: {sorted(clash)}")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # commits

    def commits(self) -> list[Commit]:
        folder = self._path(f"{self.path}/commits")
        if not self._files.exists(folder):
            return []
        rows = self.spark.read.schema("generation int, merged boolean, buckets array<int>, folder string, token string").json(f"{self.path}/commits").collect()  # a row a generation since the last vacuum
        return sorted((Commit(r.generation, r.merged, tuple(r.buckets or ()), r.folder, r.token) for r in rows), key=lambda c: c.generation)

    def _commit(self, commit: Commit) -> None:
        place = self._path(f"{self.path}/commits/{commit.generation:012d}.json")
        try:
            out = self._files.create(place, False)
        except Exception as problem:
            raise Conflict(f"generation {commit.generation} is taken") from problem
        out.write((json.dumps({"generation": commit.generation, "merged": commit.merged, "buckets": list(commit.buckets), "folder": commit.folder, "token": commit.token}) + "\n").encode())
        out.close()

    def live(self, as_of: int | None = None) -> dict[int, list[int]]:
        """Generations to read of every bucket, oldest first; the first may be merged rows."""
        found: dict[int, list[int]] = {}
        for commit in self.commits():
            if as_of is None or commit.generation <= as_of:
                for b in commit.buckets:
                    found[b] = [commit.generation] if commit.merged else [*found.get(b, []), commit.generation]
        return found

    # writing

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, merged: bool, token: str | None, buckets: Sequence[int] | None = None) -> int | None:
        known = self.commits()
        if token is not None and any(c.token == token for c in known):
            return None
        generation = known[-1].generation + 1 if known else 1
        folder = uuid.uuid4().hex
        place = f"{self.path}/rows/_folder={folder}/_gen={generation}"
        key = F.coalesce(F.col(self.key), F.raise_error(F.lit("null key")).cast(self.schema[self.key].dataType))
        rows = rows.withColumn(self.key, key).withColumn("_bucket", self.bucket_of(F.col(self.key)))
        rows.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.mode("overwrite").partitionBy("_bucket").parquet(place)
        status = self._files.listStatus(self._path(place))
        touched = sorted(int(s.getPath().getName().split("=")[1]) for s in status if s.isDirectory() and "=" in s.getPath().getName())
        self._commit(Commit(generation, merged, tuple(sorted({*touched, *(buckets or ())})), folder, token))
        return generation

    def _changes(self, rows: DataFrame, drop: bool, present: Mapping[str, Column] | None, order: str | None) -> DataFrame:
        present = present or {}
        given = [f for f in self.fields if f in rows.columns] if not drop else []
        at = F.struct(F.coalesce(F.col(order).cast("long") if order else F.lit(None).cast("long"), F.lit(-(2**63))).alias("at"), F.lit(None).cast("int").alias("gen"))
        told = [F.when(present[f], F.struct(F.lit(f).alias("f"), at.alias("o"))) if f in present else F.struct(F.lit(f).alias("f"), at.alias("o")) for f in given]
        supplied = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit(_ROW).alias("f"), at.alias("o")), *told)))
        values = [F.col(f).cast(self.schema[f].dataType).alias(f) if f in given else F.lit(None).cast(self.schema[f].dataType).alias(f) for f in self.fields]
        return rows.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key), *values, F.lit(drop).alias("_drop"), supplied.cast(_ORDERS).alias("_has"))

    def upsert(self, rows: DataFrame, present: Mapping[str, Column] | None = None, order: str | None = None, token: str | None = None) -> int | None:
        """Supply fields of rows; unknown keys become rows. ``present`` tells of a field in which rows it is supplied.

        Nothing is read. Gives the generation, or None for a token that is known.
        """
        return self._write(self._changes(rows, False, present, order), False, token)

    def delete(self, keys: DataFrame, order: str | None = None, token: str | None = None) -> int | None:
        return self._write(self._changes(keys, True, None, order), False, token)

    def apply(self, rows: DataFrame, dropped: Column, present: Mapping[str, Column] | None = None, order: str | None = None, token: str | None = None) -> int | None:
        """Upserts and deletions of one batch together."""
        puts, drops = self._changes(rows.where(~dropped), False, present, order), self._changes(rows.where(dropped), True, None, order)
        return self._write(puts.unionByName(drops), False, token)

    def insert(self, rows: DataFrame, token: str | None = None) -> int | None:
        """Rows whose keys are not there yet; those that are stay as they are. Reads only the new keys' buckets."""
        touched = [r[0] for r in rows.select(self.bucket_of(F.col(self.key).cast(self.schema[self.key].dataType))).distinct().collect()]  # at most a row a bucket
        return self.upsert(rows.join(self.read(buckets=touched).select(self.key), self.key, "left_anti"), token=token)

    def update_by(self, function: Callable[[DataFrame], DataFrame], where: Column | None = None, token: str | None = None) -> int | None:
        """A function of the stored rows, or of some, gives changed fields by key; these are written."""
        rows = self.read()
        return self.upsert(function(rows if where is None else rows.where(where)), token=token)

    # reading

    def _rows(self, pairs: Sequence[tuple[int, int]]) -> DataFrame:
        stored = StructType([*self.schema, *StructType.fromDDL(f"_drop boolean, _has {_ORDERS}, _folder string, _gen int, _bucket int")])
        if not pairs:
            return self.spark.createDataFrame([], stored)
        folders = {c.generation: c.folder for c in self.commits()}
        places = [f"{self.path}/rows/_folder={folders[g]}/_gen={g}/_bucket={b}" for g, b in pairs]
        places = [p for p in places if self._files.exists(self._path(p))]  # a compaction may have left a bucket empty
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/rows").parquet(*places) if places else self.spark.createDataFrame([], stored)

    def read(self, buckets: Sequence[int] | None = None, as_of: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows as they are, or were after a generation. ``where`` may hold the key alone, and reaches the scan."""
        live = {b: gens for b, gens in self.live(as_of).items() if buckets is None or b in set(buckets)}
        merged = {c.generation for c in self.commits() if c.merged}
        settled = [(g[0], b) for b, g in live.items() if len(g) == 1 and g[0] in merged]
        open_ = [(g, b) for b, gens in live.items() if len(gens) > 1 or gens[0] not in merged for g in gens]
        keep = (lambda df: df) if where is None else (lambda df: df.where(where))
        names = self.schema.names
        parts = ([keep(self._rows(settled)).where("not _drop").select(*names)] if settled else []) + ([self._merged(keep(self._rows(open_))).select(*names)] if open_ else [])
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of every key: when it was last deleted, last written, and every field's last value with its order."""
        order = lambda f: F.struct(F.col("_has")[f]["at"].alias("at"), F.coalesce(F.col("_has")[f]["gen"], F.col("_gen")).alias("gen"))
        put = ~F.col("_drop")
        last = [F.max(F.when(put & F.map_contains_key("_has", f), F.struct(order(f).alias("w"), F.col(f).alias("v")))).alias(f) for f in self.fields]
        return rows.groupBy(self.key).agg(F.max(F.when(~put, order(_ROW))).alias("_gone"), F.max(F.when(put, order(_ROW))).alias("_put"), *last)

    @staticmethod
    def _since(order: Column) -> Column:
        """Whether something is newer than the deletion of its row."""
        return order.isNotNull() & (F.col("_gone").isNull() | (order > F.col("_gone")))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """The last value of every field that was supplied after the last deletion."""
        values = [F.when(self._since(F.col(f"{f}.w")), F.col(f"{f}.v")).alias(f) for f in self.fields]
        return self._last(rows).where(self._since(F.col("_put"))).select(self.key, *values)

    def find(self, keys: Sequence) -> DataFrame:
        """Rows of a few keys: only their buckets are opened, and the keys reach the scan."""
        kind = self.schema[self.key].dataType
        wanted = [F.lit(k).cast(kind) for k in keys]
        ids = self.spark.range(1).select(F.array_distinct(F.array(*[self.bucket_of(k) for k in wanted]))).first()[0] if keys else []
        return self.read(buckets=ids, where=F.col(self.key).isin(wanted) if keys else F.lit(False))

    # upkeep

    def compact(self, most: int = 4) -> list[int]:
        """Merge the buckets that have more than ``most`` generations; gives these."""
        full = sorted(b for b, gens in self.live().items() if len(gens) > most)
        if full:
            last = self._last(self._rows([(g, b) for b, gens in self.live().items() if b in full for g in gens]))
            order = lambda f, o: F.struct(F.lit(f).alias("f"), o.alias("o"))
            orders = F.map_from_entries(F.array_compact(F.array(order(_ROW, F.col("_put")), *[F.when(self._since(F.col(f"{f}.w")), order(f, F.col(f"{f}.w"))) for f in self.fields])))
            rows = last.where(self._since(F.col("_put"))).select(self.key, *[F.when(self._since(F.col(f"{f}.w")), F.col(f"{f}.v")).alias(f) for f in self.fields], F.lit(False).alias("_drop"), orders.alias("_has"))
            empty = [F.lit(None).cast(self.schema[f].dataType).alias(f) for f in self.fields]
            gone = last.where(F.col("_gone").isNotNull()).select(self.key, *empty, F.lit(True).alias("_drop"), F.map_from_entries(F.array(order(_ROW, F.col("_gone")))).alias("_has"))
            self._write(rows.unionByName(gone), True, None, full)
        return full

    def vacuum(self) -> int:
        """Delete generations that no bucket needs any more, and their commits; gives how many."""
        needed = {g for gens in self.live().values() for g in gens}
        last = max((c.generation for c in self.commits()), default=0)
        gone = [c for c in self.commits() if c.generation not in needed and c.generation != last]
        for c in gone:
            self._files.delete(self._path(f"{self.path}/rows/_folder={c.folder}"), True)
            if c.token is None:  # a token must stay known
                self._files.delete(self._path(f"{self.path}/commits/{c.generation:012d}.json"), False)
        return len(gone)
