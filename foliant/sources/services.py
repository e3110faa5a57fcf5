"""Services that list their records: served tables, incremental pull as a stream, and filtered reads.

A service lists records by time of update. What it has to offer is small: its newest time, time slices of a
bounded number of records, and a page of a slice from a cursor on. The cursor is the time and key of the last
record seen, so records that leave a slice while it is read, because they are updated, shift nothing.

``pull`` is a stream over a service. Its offset is the newest time that was asked for; a batch is all that was
updated since the last one, a task reads one slice page by page, and a page that fails is asked for again with
growing waits. A record that is updated while a batch runs comes with the next batch. Nothing of a service is
kept by the stream but the offset in its checkpoint.

``filtered`` is a batch source over a served table. It takes the filters that Parquet statistics can answer,
leaves out files and row groups that cannot match, reads only the columns of its schema, and gives Arrow batches.
"""

from __future__ import annotations

import datetime as dt
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from foliant.shipping import map_arrow, ship_to_driver
from foliant.storage import materialize

#: Of a worker process: row groups by path and column, and the rows that were read last. Served files do not change.
_groups: dict[tuple[str, str], list] = {}
_last: dict[str, Any] = {}
#: Of a worker process: the row groups of the files that pages are read from, and the one that was read last.
_pages: dict[str, Any] = {}

#: A time before all times.
FIRST = "0001-01-01T00:00:00"


def tried(call: Callable[[int], Any], attempts: int, wait: float, transient: tuple[type[BaseException], ...] = (OSError, TimeoutError)) -> tuple[Any, int]:
    """What a call gives, asked up to ``attempts`` times with waits that double, and how often it was asked.

    The call gets the number of the attempt, from 1. Errors that are not transient, and the last one, are raised
    with ``attempts`` as an attribute.
    """
    for attempt in range(1, attempts + 1):
        try:
            return call(attempt), attempt
        except Exception as problem:
            problem.attempts = attempt
            if attempt == attempts or not isinstance(problem, transient):
                raise
            time.sleep(wait * 2 ** (attempt - 1))
    raise ValueError("at least one attempt is needed")


@dataclass(frozen=True)
class ServedTable:
    """Parquet files, in any store, as a service: records by ``updated`` and ``key``. Files written in ranges of
    ``updated`` make narrow slices."""

    path: str
    updated: str
    key: str

    def dataset(self) -> ds.Dataset:
        system, place = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        return ds.dataset(place, filesystem=system, format="parquet", exclude_invalid_files=False)

    def _bounds(self) -> list[tuple[dt.datetime, dt.datetime]]:
        """Least and greatest time of every row group, from the files' footers."""
        found = []
        for fragment in self.dataset().get_fragments():
            for part in fragment.split_by_row_group():
                for group in part.row_groups:
                    told = (group.statistics or {}).get(self.updated)
                    if told:
                        found.append((told["min"], told["max"]))
        return sorted(found)

    def groups(self, column: str) -> list[tuple[Any, Any, ds.ParquetFileFragment]]:
        """Least and greatest value of a column, by row group, in order; footers are read once a process."""
        found = _groups.get((self.path, column))
        if found is None:
            parts = [part for f in self.dataset().get_fragments() for part in f.split_by_row_group()]
            told = [((part.row_groups[0].statistics or {}).get(column), part) for part in parts]
            found = _groups[self.path, column] = sorted(((t["min"], t["max"], part) for t, part in told if t), key=lambda g: g[:2])
        return found

    def column_at(self, value: Any, by: str, name: str) -> pa.Table:
        """``by`` and another column of the row groups that may hold a value of ``by``; the last ones stay in memory."""
        groups = self.groups(by)
        at = [i for i in range(bisect_right(groups, value, key=lambda g: g[0])) if groups[i][1] >= value]
        known = (self.path, by, name, tuple(at))
        if _last.get("of") != known:
            _last.update(of=known, rows=pa.concat_tables([groups[i][2].to_table(columns=list(dict.fromkeys((by, name)))) for i in at]) if at else None)
        return _last["rows"] if at else pa.table({by: [], name: []})

    def newest(self) -> str | None:
        newest = max((high for _, high in self._bounds()), default=None)
        return newest and newest.isoformat()

    def slices(self, since: str, until: str) -> list[tuple[str, str]]:
        """Ranges of time after ``since`` up to ``until``, cut where row groups end."""
        low, high = dt.datetime.fromisoformat(since), dt.datetime.fromisoformat(until)
        cuts = sorted({min(b, high) for a, b in self._bounds() if b > low and a <= high} | {high})
        return [(a.isoformat(), b.isoformat()) for a, b in zip([low, *cuts], cuts) if a < b]

    def page(self, after: str, last_key: Any, until: str, limit: int, columns: Sequence[str], attempt: int = 1) -> pa.Table:
        """The next records after a time, or after a key of that time, in order."""
        first, last = dt.datetime.fromisoformat(after), dt.datetime.fromisoformat(until)
        time_, stop, start = pc.field(self.updated), pa.scalar(last), pa.scalar(first)
        begun = time_ > start if last_key is None else (time_ > start) | ((time_ == start) & (pc.field(self.key) > last_key))
        names = list(dict.fromkeys([*columns, self.updated, self.key]))
        rows = None
        for low, high, part in self._ordered():
            if high[0] < first or high[0] == first and (last_key is None or high[1:] and high[1] <= last_key):
                continue
            if low[0] > last:
                break
            if rows is not None and rows.num_rows >= limit and low > (rows.column(self.updated)[limit - 1].as_py(), rows.column(self.key)[limit - 1].as_py()):
                break  # this row group and all later ones begin after the page
            more = self._read(part, names).filter(begun & (time_ <= stop))
            rows = more if rows is None else pa.concat_tables([rows, more])
            rows = rows.sort_by([(self.updated, "ascending"), (self.key, "ascending")]).slice(0, limit)
        return rows if rows is not None else self.dataset().schema.empty_table().select(names)

    def _ordered(self) -> list[tuple[tuple, tuple, ds.ParquetFileFragment]]:
        """Row groups with bounds of their times and keys, by the lower ones; footers are read once for a set of files."""
        whole = self.dataset()
        known = (self.path, tuple(whole.files))
        if _pages.get("of") != known:
            found = []
            for part in (p for f in whole.get_fragments() for p in f.split_by_row_group()):
                told = part.row_groups[0].statistics or {}
                if self.updated not in told:
                    found.append(((dt.datetime.min,), (dt.datetime.max,), part))
                    continue
                keys = {side: (told[self.key][side],) if self.key in told else () for side in ("min", "max")}
                found.append(((told[self.updated]["min"], *keys["min"]), (told[self.updated]["max"], *keys["max"]), part))
            _pages.clear()
            _pages.update(of=known, groups=sorted(found, key=lambda g: g[:2]))
        return _pages["groups"]

    def _read(self, part: ds.ParquetFileFragment, names: list[str]) -> pa.Table:
        """A row group; the one that was read last stays in memory, as the next page begins in it."""
        known = (part.path, part.row_groups[0].id, tuple(names))
        if _pages.get("read") != known:
            _pages.update(read=known, rows=part.to_table(columns=names, use_threads=False))
        return _pages["rows"]


def _fetch(fetch: Callable[[Any, int], str | None], attempts: int, wait: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key in enumerate(batch.column(0).to_pylist()):  # what has come is passed on
                content, error = None, None
                try:
                    content, _ = tried(lambda attempt: fetch(key, attempt), attempts, wait)  # noqa: B023
                except Exception as problem:  # one item must not stop the others
                    error = str(problem) or type(problem).__name__
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([content], pa.string()), pa.array([error], pa.string())], ["_key", "content", "error"])

    return run


def with_content(items: DataFrame, key: str, fetch: Callable[[Any, int], str | None], attempts: int = 3, wait: float = 0.1, parts: int | None = None) -> DataFrame:
    """Items with ``content`` and ``error``: what a service has for their key, asked for once a key, with some attempts.

    What the service does not know is null without error; null keys are not asked for. The answers are written, so
    that nothing is asked for again when the result is read twice. ``parts`` requests run at a time.
    """
    keys = items.where(items[key].isNotNull()).select(items[key].alias("_key")).distinct()
    parts = parts or 2 * items.sparkSession.sparkContext.defaultParallelism
    keys = keys.repartitionByRange(parts, "_key").sortWithinPartitions("_key")  # neighbours are asked for one after the other
    kind = items.schema[key].dataType.simpleString()
    answers = materialize(map_arrow(keys, _fetch(fetch, attempts, wait), f"_key {kind}, content string, error string"), "service-answers")
    return items.join(answers, items[key] == answers["_key"], "left").drop("_key")


class _PullReader(DataSourceStreamReader):
    def __init__(self, service: ServedTable, columns: Sequence[str], since: str, size: int, attempts: int, wait: float):
        self.service, self.columns, self.since, self.size, self.attempts, self.wait = service, list(columns), since, size, attempts, wait

    def initialOffset(self) -> dict:
        return {"until": self.since}

    def latestOffset(self) -> dict:
        return {"until": max(self.since, tried(lambda _: self.service.newest(), self.attempts, self.wait)[0] or self.since)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start["until"] >= end["until"]:
            return []
        return [InputPartition(part) for part in tried(lambda _: self.service.slices(start["until"], end["until"]), self.attempts, self.wait)[0]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        (after, until), last = partition.value, None
        while True:
            rows, _ = tried(lambda attempt: self.service.page(after, last, until, self.size, self.columns, attempt), self.attempts, self.wait)  # noqa: B023
            yield from rows.select(self.columns).to_batches()
            if rows.num_rows < self.size:
                return
            end = rows.slice(rows.num_rows - 1)
            after, last = end.column(self.service.updated)[0].as_py().isoformat(), end.column(self.service.key)[0].as_py()

    def commit(self, end: dict) -> None:
        """Nothing is kept at the service."""


def pull(spark: SparkSession, name: str, service: ServedTable, schema: StructType | str, since: str = FIRST, size: int = 1000, attempts: int = 3, wait: float = 0.1) -> DataFrame:
    """A stream of a service's records as they are updated, from ``since`` on; at least once, by version exactly once
    into a sink that counts batches. Columns are those of the schema."""
    ship_to_driver(spark)
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return kinds

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _PullReader(service, schema.names, since, size, attempts, wait)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


_COMPARISONS = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


def as_arrow(condition: Filter) -> pc.Expression | None:
    """A pushed filter as an Arrow expression; None where it has no counterpart."""
    if len(getattr(condition, "attribute", ())) != 1:
        return None
    field = pc.field(condition.attribute[0])
    if isinstance(condition, IsNotNull):
        return field.is_valid()
    if isinstance(condition, In):
        return field.isin(list(condition.value)) if None not in condition.value else None
    if type(condition) in _COMPARISONS and condition.value is not None:
        return getattr(field, _COMPARISONS[type(condition)])(pa.scalar(condition.value))
    return None


class _FilteredReader(DataSourceReader):
    """Reads row groups that may match. Only what is pushed here is filtered here."""

    def __init__(self, table: ServedTable, columns: Sequence[str]):
        self.table, self.columns, self.condition = table, list(columns), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            found = as_arrow(one)
            if found is None:
                yield one  # Spark's
            else:
                self.condition = found if self.condition is None else self.condition & found

    def partitions(self) -> Sequence[InputPartition]:
        fragments = self.table.dataset().get_fragments(filter=self.condition)
        parts = [(part.path, [g.id for g in part.row_groups]) for f in fragments for part in f.split_by_row_group(self.condition)]
        return [InputPartition(p) for p in parts] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, groups = partition.value
        whole = self.table.dataset()
        for fragment in whole.get_fragments():
            if fragment.path == path:
                chosen = fragment.format.make_fragment(path, filesystem=whole.filesystem, row_groups=groups)
                yield from (b for b in chosen.to_batches(schema=whole.schema, columns=self.columns, filter=self.condition) if b.num_rows)


def filtered(spark: SparkSession, name: str, table: ServedTable, schema: StructType | str, where: str | None = None) -> DataFrame:
    """Rows of a served table, with the schema's columns alone; filters that Arrow understands reach the files.

    The session's pushdown to Python sources is switched on, as plans are made when the result is used.
    """
    ship_to_driver(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return kinds

        def reader(self, schema: StructType) -> DataSourceReader:
            return _FilteredReader(table, schema.names)

    spark.dataSource.register(Source)
    df = spark.read.format(name).load()
    return df if where is None else df.where(where)
