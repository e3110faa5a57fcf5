"""URL filter by the ratio of two character language models.

Rules decide first: a rule names a host, with all its subdomains, and how a path begins; of the rules
that fit, the longest wins. URLs that a rule accepts and URLs that a rule rejects make one Markov model
each. A model counts the runs of up to six bytes of all its URLs; the probability of a byte is
interpolated over contexts of nought to five bytes, each order smoothed with the shorter one, so a
context that was never seen leaves the shorter one's answer. Counts are exact: a run's key holds its
bytes and its length. They are summed over the cluster into a written table. Up to ``BOUND`` different
runs are sent to every executor; beyond it each run's log-likelihood difference is found by joins, the
most frequent ones are sent, and the others are joined to the URLs that hold them.

A URL without a rule is judged by the difference of its log-likelihoods under both models, divided by
its length, which count all ruled URLs. The cut between allow and block has the smallest balanced error
on a fifth of the ruled URLs under models that count the other four fifths.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; null counts as
an empty URL for the models; without URLs of both kinds all others are allowed; repeated rows count each
and get equal results; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.textops import text_chunks
from foliant.shipping import map_arrow
from foliant.storage import materialize

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 5
#: Pull of the shorter context, in observations.
PULL = 3.0
#: Different runs that are sent to every executor at most.
BOUND = 1 << 20
#: Scores are calibrated in bins of this width, from -LIMIT to LIMIT.
BIN, LIMIT = 0.002, 8.0
_AFTER = r"://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a URL without ``://``."""
    safe = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(safe, _AFTER, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(safe, _AFTER, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of the longest rule that fits and its verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


_END = 0xFF  # no byte of UTF-8
#: A key is a run's length above this bit and its bytes below.
_LENGTH = 48
#: Joined differences are whole numbers of this unit, so that their sums do not depend on the order.
_UNIT = 2.0**-32


def symbols(urls: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` with all their bytes, each URL closed by an end symbol, and where each begins."""
    for lo, hi, data, offsets in text_chunks(urls):
        begins = offsets[:-1] + np.arange(hi - lo)
        out = np.full(len(data) + hi - lo, _END, dtype=np.uint8)
        sizes = np.diff(offsets)
        out[np.arange(len(data)) + np.repeat(np.arange(hi - lo), sizes)] = data
        yield lo, hi, out, begins


def runs(data: np.ndarray, begins: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to ``order`` + 1, at most 6: where runs of that length end, and their keys."""
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    packed, out = np.zeros(len(data), dtype=np.int64), []
    for n in range(1, order + 2):
        packed[n - 1 :] |= data[: max(0, len(data) - n + 1)].astype(np.int64) << 8 * (n - 1)
        ends = np.flatnonzero(place >= n - 1)
        out.append((ends, packed[ends] | n << _LENGTH))
    return out


class Counts(NamedTuple):
    """Runs in ascending order of their keys, and how often accepted, rejected and other URLs hold each."""

    keys: np.ndarray
    counts: np.ndarray  # 3 x runs


@dataclass
class UrlModels:
    """Counts of accepted and of rejected URLs by run, and their numbers of symbols."""

    counts: Counts
    totals: np.ndarray  # 2
    order: int = ORDER
    pull: float = PULL

    def seen(self, keys: np.ndarray) -> np.ndarray:
        at, hit = find(self.counts.keys, keys)
        return np.where(hit, self.counts.counts[:2, at], 0)

    def log_probabilities(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of every symbol under both models."""
        p = np.full((2, len(data)), 1 / 256)
        context = np.repeat(self.totals[:, None].astype(np.float64), len(data), axis=1)  # of the empty context
        for ends, keys in runs(data, begins, self.order):
            seen = self.seen(keys)
            p[:, ends] = (seen + self.pull * p[:, ends]) / (context[:, ends] + self.pull)
            context[:, :] = 0
            following = ends + 1
            inside = following < len(data)
            context[:, following[inside]] = seen[:, inside]
        return np.log(p)

    def scores(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Mean log-likelihood difference of each URL's symbols; above 0 it is liker the accepted ones."""
        good, bad = self.log_probabilities(data, begins)
        return np.add.reduceat(good - bad, begins) / np.diff(np.append(begins, len(data)))


def find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the ascending, not empty ``known``, and whether each is there."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def counts_of(urls: pa.Array, good: np.ndarray, ruled: np.ndarray | None = None) -> tuple[Counts, np.ndarray]:
    """Counts by kind and run, and symbols of accepted and rejected URLs; without ``ruled`` every URL is one of them."""
    kinds = np.where(good, 0, 1) if ruled is None else np.where(ruled, np.where(good, 0, 1), 2)
    found, totals = [Counts(np.zeros(0, dtype=np.int64), np.zeros((3, 0), dtype=np.int64))], np.zeros(2, dtype=np.int64)
    for lo, hi, data, begins in symbols(urls):
        kind = np.repeat(kinds[lo:hi], np.diff(np.append(begins, len(data))))
        totals += np.bincount(kind, minlength=3)[:2]
        for ends, keys in runs(data, begins):
            different, which = np.unique(keys, return_inverse=True)
            found.append(Counts(different, np.bincount(which + len(different) * kind[ends], minlength=3 * len(different)).reshape(3, -1)))
    keys, which = np.unique(np.concatenate([x.keys for x in found]), return_inverse=True)
    counts = np.zeros((3, len(keys)), dtype=np.int64)
    np.add.at(counts, (slice(None), which), np.concatenate([x.counts for x in found], axis=1))
    return Counts(keys, counts), totals


_COUNTED = ["run", "good", "bad", "used_good", "used_bad", "n"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, ruled, aside = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("good", "ruled", "aside"))
        for part in (False, True):
            (keys, counts), _ = counts_of(batch.column("url").filter(pa.array(aside == part)), good[aside == part], ruled[aside == part])
            used = counts * (not part)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, counts[0], counts[1], used[0], used[1], counts.sum(axis=0))], _COUNTED)


def count_runs(urls: DataFrame) -> DataFrame:
    """``run, good, bad, used_good, used_bad, n`` of rows of ``url, good, ruled, aside``.

    Times in accepted and in rejected URLs, the same without URLs put aside, and times in all URLs.
    """
    return map_arrow(urls, _count, ", ".join(f"{x} long" for x in _COUNTED)).groupBy("run").agg(*[F.sum(x).alias(x) for x in _COUNTED[1:]])


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: UrlModels = shared.value
        for batch in batches:
            rest = batch.select([x for x in batch.schema.names if x != "url"])
            for lo, hi, data, begins in symbols(batch.column("url")):
                part = rest.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(models.scores(data, begins))], [*part.schema.names, "score"])

    return run


def differences(counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """``run, n, ratio``: the difference of the last byte's log-likelihoods after the rest of the run, in units.

    ``counts`` holds the runs of all URLs that are judged, so a run's context and its shorter form have rows.
    At most 256 runs meet one context or one shorter form.
    """
    levels: list[DataFrame] = []
    for n in range(1, ORDER + 2):
        level = counts.where(F.shiftright("run", _LENGTH) == n)
        if n == 1:
            level = level.select("*", *[F.lit(float(x)).alias(f"of_{k}") for k, x in zip(("good", "bad"), totals)], *[F.lit(1 / 256).alias(f"p_{k}") for k in ("good", "bad")])
        else:
            shift = F.lit((n - 1) << _LENGTH)
            level = level.withColumns({"context": F.shiftright(F.col("run") - (n << _LENGTH), 8) + shift, "shorter": F.col("run").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)) + shift})
            contexts = counts.where(F.shiftright("run", _LENGTH) == n - 1).select(F.col("run").alias("context"), F.col("good").alias("of_good"), F.col("bad").alias("of_bad"))
            level = level.join(contexts, "context").join(levels[-1].select(F.col("run").alias("shorter"), "p_good", "p_bad"), "shorter")
        level = level.select("run", "n", *[((F.col(k) + PULL * F.col(f"p_{k}")) / (F.col(f"of_{k}") + PULL)).alias(f"p_{k}") for k in ("good", "bad")])
        levels.append(materialize(level, f"url-runs-{n}"))
    ratio = F.round((F.log("p_good") - F.log("p_bad")) / _UNIT).cast("long")
    return reduce(DataFrame.unionByName, levels).select("run", "n", ratio.alias("ratio"))


def _look_up(shared):
    """Of each URL the sum of the differences that are at hand, without a run, and a row for each other run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratios = shared.value
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for lo, hi, data, begins in symbols(batch.column("url")):
                longest = np.zeros(len(data), dtype=np.int64)
                for ends, keys in runs(data, begins):
                    longest[ends] = keys
                at, hit = find(known, longest)
                sums = np.add.reduceat(np.where(hit, ratios[at], 0), begins)
                owners = np.repeat(ids[lo:hi], np.diff(np.append(begins, len(data))))[~hit]
                of = pa.concat_arrays([pa.nulls(hi - lo, pa.int64()), pa.array(longest[~hit])])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[lo:hi], owners)), of, pa.array(np.append(sums, np.zeros(len(owners), dtype=np.int64)))], ["row", "run", "ratio"])

    return run


def joined_scores(rows: DataFrame, counts: DataFrame, totals: np.ndarray, bound: int) -> DataFrame:
    """``rows`` with their score for ``url``, by at most ``bound`` differences sent and the others joined."""
    ratios = materialize(differences(counts, totals), "url-runs")
    bits = F.length(F.bin("n"))
    sizes = ratios.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("k")).toPandas().sort_values("bits", ascending=False)  # at most 63 rows
    fits = sizes["bits"][sizes["k"].cumsum() <= bound]
    least = int(fits.min()) if len(fits) else 64
    sent = ratios.where(bits >= least).select("run", "ratio").toArrow().sort_by("run")  # at most ``bound`` rows
    known = sent["run"].to_numpy(), sent["ratio"].to_numpy()
    if not len(known[0]):
        known = np.full(1, -1), np.zeros(1, dtype=np.int64)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    parts = map_arrow(rows.select("row", "url"), _look_up(rows.sparkSession.sparkContext.broadcast(known)), "row long, run long, ratio long")
    parts = materialize(parts, "url-parts")
    rare = parts.where(F.col("run").isNotNull()).select("row", "run").join(ratios.where(bits < least).select("run", "ratio"), "run")
    sums = parts.where(F.col("run").isNull()).select("row", "ratio").unionByName(rare.select("row", "ratio")).groupBy("row").agg(F.sum("ratio").alias("ratio"))
    size = F.octet_length(F.coalesce("url", F.lit(""))) + 1
    return rows.join(sums, "row").withColumn("score", F.col("ratio") * _UNIT / size).drop("row", "ratio", "url")


def best_cut(scored: DataFrame) -> float:
    """Cut of the smallest balanced error over rows of ``score, good``, from counts of score bins."""
    at = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / BIN)
    bins = scored.groupBy(at.alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("bin")
    if not len(bins) or not bins["good"].sum() or not bins["bad"].sum():
        return 0.0
    lost = np.append(0, np.cumsum(bins["good"])) / bins["good"].sum()
    let = 1 - np.append(0, np.cumsum(bins["bad"])) / bins["bad"].sum()
    edges = np.append(bins["bin"], bins["bin"].iloc[-1] + 1)
    best = np.flatnonzero(lost + let == (lost + let).min())
    below = edges[best[0] - 1] + 1 if best[0] else edges[0]
    return float((below + edges[best[-1]]) / 2 * BIN)


def _scored(rows: DataFrame, counts: DataFrame, prefix: str, bound: int, small: bool) -> DataFrame | None:
    """``rows`` with their score instead of ``url``, under the models of the counts named with ``prefix``; None if a kind has no URL."""
    counts = counts.select("run", *[F.col(prefix + k).alias(k) for k in ("good", "bad")], "n")
    single = F.shiftright("run", _LENGTH) == 1
    totals = np.array(counts.agg(*[F.coalesce(F.sum(F.when(single, F.col(k))), F.lit(0)) for k in ("good", "bad")]).first())
    if not totals.all():
        return None
    if not small:
        return materialize(joined_scores(rows, counts, totals, bound), "url-scores")
    table = counts.where("good + bad > 0").toArrow().sort_by("run")  # at most ``bound`` rows
    models = UrlModels(Counts(table["run"].to_numpy(), np.stack([table[k].to_numpy() for k in ("good", "bad")]).astype(np.float64)), totals)
    kept = rows.drop("url")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return materialize(map_arrow(rows, _judge(rows.sparkSession.sparkContext.broadcast(models)), f"{schema}, score double"), "url-scores")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, bound: int = BOUND, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path")).withColumn("_match", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("_match.rule").alias("rule"), F.col("_match.verdict").alias("ruled"), "url")
    good, ruled, aside = F.coalesce(F.col("ruled") == "allow", F.lit(False)), F.col("ruled").isNotNull(), F.crc32(F.coalesce("url", F.lit(""))) % 5 == 0
    counts = materialize(count_runs(rows.select("url", good.alias("good"), ruled.alias("ruled"), aside.alias("aside"))), "url-counts")
    small, cut = counts.count() <= bound, 0.0
    scored = _scored(rows, counts, "", bound, small)
    if scored is None:
        scored = rows.drop("url").withColumn("score", F.lit(0.0))
    else:
        held = _scored(rows.where(ruled & aside).select("url", good.alias("good")), counts, "used_", bound, small)
        cut = best_cut(held) if held is not None else 0.0
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
