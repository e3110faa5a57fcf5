"""Scraping a site that lists documents by day, in pages, and is not to be relied on.

First the site is asked, for every day, how many documents it has; that plans the pages. Then the pages are
fetched, by executors, each with some attempts and growing waits. A page that stays dead is kept with its error.
What was listed is compared with what was reported; days that disagree or have dead pages are planned anew, and
only pages that are dead or new are fetched again. Every round is written before it is looked at, so no page is
fetched twice because a plan is run twice.

A count that is too small by just what stands on pages that were not planned agrees with what was listed, and cannot
be told from a right one.

Defined cases: a day without documents has no pages and agrees; a day whose count cannot be had is kept with the
error and no count; a null page of ids counts as none; repeated days are asked once; no days give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from foliant.shipping import map_arrow
from foliant.sources.services import ServedTable, tried
from foliant.storage import materialize

PLAN = "day string, n_reported long, n_asked int, count_error string"
PAGES = "day string, page int, attempts int, ids array<string>, error string"


class Site(Protocol):
    """What is asked of a site. ``attempt`` counts from 1, ``round_`` from 0."""

    def reported(self, day: str, attempt: int, round_: int) -> int: ...

    def listed(self, day: str, page: int, attempt: int, round_: int) -> list[str]: ...


@dataclass(frozen=True)
class Patience:
    """Documents on a page, attempts of a request, seconds before the second one, and rounds of planning."""

    page_size: int = 10
    attempts: int = 3
    wait: float = 1.0
    rounds: int = 2


def _asked(call: Callable[[int], object], patience: Patience) -> tuple[object, int, str | None]:
    """The answer or None, how often it was asked for, and the last error."""
    try:
        return *tried(call, patience.attempts, patience.wait), None
    except Exception as problem:
        return None, problem.attempts, str(problem) or type(problem).__name__


def _count(site: Site, patience: Patience, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days = batch.column(0).to_pylist()
            told = [_asked(lambda attempt: site.reported(day, attempt, round_), patience) for day in days]  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(days, pa.string()), pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int32()), pa.array([t[2] for t in told], pa.string())], ["day", "n_reported", "n_asked", "count_error"])

    return run


def _fetch(site: Site, patience: Patience, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for day, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):  # a row a request: what has come is passed on
                ids, attempts, error = _asked(lambda attempt: list(site.listed(day, page, attempt, round_)), patience)  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array([day]), pa.array([page], pa.int32()), pa.array([attempts], pa.int32()), pa.array([ids], pa.list_(pa.string())), pa.array([error], pa.string())], ["day", "page", "attempts", "ids", "error"])

    return run


def plan(days: DataFrame, site: Site, patience: Patience, round_: int = 0) -> DataFrame:
    """What the site reports of every day (``PLAN``)."""
    return map_arrow(days.select("day").where("day is not null").distinct(), _count(site, patience, round_), PLAN)


def pages_of(planned: DataFrame, patience: Patience) -> DataFrame:
    """``day, page`` of all pages that the reported documents fill."""
    last = F.ceil(F.col("n_reported") / patience.page_size).cast("int")
    return planned.where("n_reported > 0").select("day", F.explode(F.sequence(F.lit(0), last - 1)).alias("page"))


def _in_order(wanted: DataFrame) -> DataFrame:
    """Requests in ranges over all cores, pages of a day one after the other, so a site can keep what it looked up."""
    parts = 2 * wanted.sparkSession.sparkContext.defaultParallelism
    return wanted.repartitionByRange(parts, "day", "page").sortWithinPartitions("day", "page")


def reconcile(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """Of every planned day what was reported and listed, how many pages are dead, and whether it is settled."""
    seen = pages.groupBy("day").agg(F.sum(F.coalesce(F.size("ids"), F.lit(0))).alias("n_listed"), F.count_if(F.col("error").isNotNull()).alias("n_dead"), F.sum("attempts").alias("n_requests"))
    days = planned.join(seen, "day", "left").na.fill(0, ["n_listed", "n_dead", "n_requests"])
    return days.withColumn("settled", F.coalesce((F.col("n_reported") == F.col("n_listed")) & (F.col("n_dead") == 0), F.lit(False)))


def scrape(days: DataFrame, site: Site, patience: Patience | None = None) -> tuple[DataFrame, DataFrame]:
    """The pages (``PAGES``, dead ones with their error) and the days, reconciled, after all rounds."""
    patience = patience or Patience()
    planned = materialize(plan(days, site, patience), "scrape-plan")
    wanted = pages_of(planned, patience)
    pages = materialize(map_arrow(_in_order(wanted), _fetch(site, patience, 0), PAGES), "scrape-pages")
    for round_ in range(1, patience.rounds):
        told = materialize(reconcile(planned, pages), "scrape-days")
        open_ = told.where("not settled").select("day")
        if open_.isEmpty():
            break
        again = materialize(plan(open_, site, patience, round_), "scrape-plan")
        done = pages.where("error is null").select("day", "page")
        wanted = pages_of(again, patience).join(done, ["day", "page"], "left_anti")
        fetched = materialize(map_arrow(_in_order(wanted), _fetch(site, patience, round_), PAGES), "scrape-pages")
        kept = pages.join(fetched.select("day", "page"), ["day", "page"], "left_anti")
        pages = materialize(kept.unionByName(fetched), "scrape-pages", pages, fetched)
        planned = materialize(planned.join(again.select("day"), "day", "left_anti").unionByName(again), "scrape-plan", planned, again, told)
    return pages, reconcile(planned, pages)


#: Of a worker process: the documents of the day that was asked for last. Served files do not change.
_last: dict[str, object] = {}


@dataclass(frozen=True)
class ServedSite:
    """A served table as a site: ``updated`` holds the day as text, ``key`` the document."""

    table: ServedTable
    page_size: int = 10

    def _keys(self, day: str) -> list[str]:
        """The day's documents in order; those of the last day stay in memory for its other pages."""
        known = (self.table.path, self.table.updated, self.table.key, day)
        if _last.get("of") != known:
            rows = self.table.dataset().to_table(columns=[self.table.key], filter=pc.field(self.table.updated) == day)
            _last.update(of=known, keys=sorted(str(k) for k in rows.column(0).to_pylist()))
        return _last["keys"]

    def reported(self, day: str, attempt: int, round_: int) -> int:
        return len(self._keys(day))

    def listed(self, day: str, page: int, attempt: int, round_: int) -> list[str]:
        return self._keys(day)[page * self.page_size : (page + 1) * self.page_size]
