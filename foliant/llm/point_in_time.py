"""Point-in-time feature join over persistent ordered trees.

A version of a key is active from the later of its event and its arrival until it expires. Time is cut into
blocks of a power of two. Of a version, the parts in the blocks where it starts and where it ends are edits of
those blocks; the blocks between, which it covers whole, are named by at most two nodes a level of a binary
hierarchy over blocks. Equal parts and equal nodes keep only the version that would win, before anything is
shuffled, so a block of ``w`` time units holds at most ``w * w / 2`` edits and ``w`` asked times, however many
rows there are.

In a block, versions are slots of a tree in the order in which they win. Start and expiry edits, by time, copy
the path from the slot to the root; every time has the root of the tree as it was then. An asked time
binary-searches its root and reads the tree's maximum. Times asked more than once are answered once; labels meet
the answers by key and time.

Everything is joined and grouped by key and time or key and block, so a key with most of the rows is spread like
all the others. Joins are merge joins: nothing is broadcast.

Defined cases: versions whose key, event, arrival or expiry is null are never active, nor are those that expire
before they could start; labels with null key or time have no winner; a start counts at its time and an expiry
does not; of versions with equal event, arrival and identifier the one with the greatest carried values wins
(null least); repeated versions count once, repeated labels are answered each; empty tables give no rows, or
labels without winner.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.textops import sorted_groups
from foliant.shipping import map_arrow

#: Bits of time within a block.
BLOCK_BITS = 8


class ActiveVersions:
    """A persistent tree over slots in ascending order; every edit leaves all earlier roots as they are.

    Nodes are numbered; node 0 is the empty tree. A node holds how many versions are active below it.
    """

    def __init__(self, slots: int):
        self.height = max(0, slots - 1).bit_length()
        self.left, self.right, self.active = [0], [0], [0]
        self.times: list[int] = []
        self.roots: list[int] = []

    def edit(self, time: int, slot: int, change: int) -> None:
        """Copy the path to ``slot`` with ``change`` more versions active there; times must not descend."""
        left, right, active = self.left, self.right, self.active
        node, root = self.roots[-1] if self.roots else 0, len(active)
        for bit in range(self.height - 1, -1, -1):
            copy = len(active)
            active.append(active[node] + change)
            if slot >> bit & 1:
                left.append(left[node])
                right.append(copy + 1)
                node = right[node]
            else:
                left.append(copy + 1)
                right.append(right[node])
                node = left[node]
        active.append(active[node] + change)
        left.append(0)
        right.append(0)
        if self.times and self.times[-1] == time:
            self.roots[-1] = root
        else:
            self.times.append(time)
            self.roots.append(root)

    def greatest(self, time: int) -> int | None:
        """The greatest slot active at a time."""
        at = bisect_right(self.times, time) - 1
        node = self.roots[at] if at >= 0 else 0
        if not self.active[node]:
            return None
        slot = 0
        for bit in range(self.height - 1, -1, -1):
            if self.active[self.right[node]]:
                slot |= 1 << bit
                node = self.right[node]
            else:
                node = self.left[node]
        return slot


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of whole blocks. A block's versions come first, in the order in which they win, then its asked times."""
    for rows in sorted_groups(batches, ["key", "block"], 20_000, 4 << 20):
        rows = rows.combine_chunks()
        asks, begins = rows.column("asks").to_numpy(), rows.column("begins").to_numpy()
        ends = pc.fill_null(rows.column("ends"), 0).to_numpy()
        group = np.zeros(rows.num_rows, dtype=bool)
        for name in ("key", "block"):
            column = rows.column(name)
            group[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        group[0] = True
        edges = np.append(np.flatnonzero(group), rows.num_rows).tolist()
        asked, winner = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            n = b - a - int(asks[a:b].sum())
            tree = ActiveVersions(n)
            starts, stops = begins[a : a + n].tolist(), ends[a : a + n].tolist()
            for time, slot, change in sorted([(t, i, 1) for i, t in enumerate(starts)] + [(t, i, -1) for i, t in enumerate(stops)]):
                tree.edit(time, slot, change)
            for row, time in zip(range(a + n, b), begins[a + n : b].tolist()):
                slot = tree.greatest(time)
                if slot is not None:
                    asked.append(row)
                    winner.append(a + slot)
        yield pa.RecordBatch.from_arrays(
            [rows.column("key").take(pa.array(asked, pa.int64())).combine_chunks(), pa.array(begins[asked], pa.int64()), rows.column("best").take(pa.array(winner, pa.int64())).combine_chunks()], ["key", "asked", "best"]
        )


def _parts(start: Column, expiry: Column, bits: int) -> Column:
    """Edits of the blocks where a version starts and ends, unless it covers them."""
    mask = (1 << bits) - 1
    first, last = F.shiftright(start, bits), F.shiftright(expiry, bits)
    starts_inside, ends_inside = start.bitwiseAND(F.lit(mask)) != 0, expiry.bitwiseAND(F.lit(mask)) != 0
    part = lambda block, begins, ends: F.struct(block.alias("block"), begins.alias("begins"), ends.alias("ends"))
    return F.filter(
        F.array(
            F.when(starts_inside, part(first, start, F.least(expiry, F.shiftleft(first + 1, bits)))),
            F.when(ends_inside & ((last > first) | ~starts_inside), part(last, F.shiftleft(last, bits), expiry)),
        ),
        lambda p: p.isNotNull(),
    )


def _covered(start: Column, expiry: Column, bits: int, levels: int) -> Column:
    """Nodes of the hierarchy that together are the blocks which a version covers."""
    first, end = F.shiftright(start + ((1 << bits) - 1), bits), F.shiftright(expiry, bits)
    nodes = []
    for level in range(levels + 1):
        low, high = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(end, level)
        node = lambda i: F.struct(F.lit(level).alias("level"), i.alias("node"))  # noqa: E731, B023
        nodes += [F.when((low < high) & (low % 2 != 0), node(low)), F.when((low < high) & (high % 2 != 0), node(high - 1))]
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def winners(versions: DataFrame, asked: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``key, asked, best`` for every pair of ``asked`` (columns ``key, asked``) with an active version.

    ``versions`` has ``key, start, expiry`` and ``best``, a struct whose greatest value wins.
    """
    versions = versions.where(F.col("key").isNotNull() & (F.col("start") < F.col("expiry")))
    longest = versions.agg(F.max(F.shiftright(F.col("expiry") - F.col("start"), bits)).alias("n")).first()["n"] or 0
    levels = int(longest).bit_length()
    asked = asked.where(F.col("key").isNotNull() & F.col("asked").isNotNull()).distinct().withColumn("block", F.shiftright("asked", bits))
    start, expiry = F.col("start"), F.col("expiry")

    edits = versions.select("key", F.explode(_parts(start, expiry, bits)).alias("p"), "best")
    edits = edits.groupBy("key", "p.block", "p.begins", "p.ends").agg(F.max("best").alias("best"))
    covers = versions.select("key", F.explode(_covered(start, expiry, bits, levels)).alias("n"), "best")
    covers = covers.groupBy("key", "n.level", "n.node").agg(F.max("best").alias("best"))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("block"), k).alias("node"))))
    blocks = asked.select("key", "block").distinct().select("key", "block", above.alias("n")).select("key", "block", "n.level", "n.node")
    covering = blocks.join(covers.hint("merge"), ["key", "level", "node"]).groupBy("key", "block").agg(F.max("best").alias("best"))
    whole = covering.select("key", "block", F.shiftleft("block", bits).alias("begins"), F.shiftleft(F.col("block") + 1, bits).alias("ends"), "best")

    kind = versions.schema["best"].dataType
    ask = asked.select("key", "block", F.col("asked").alias("begins"), F.lit(None).cast("long").alias("ends"), F.lit(None).cast(kind).alias("best"), F.lit(True).alias("asks"))
    edits = edits.select("key", "block", "begins", "ends", "best").unionByName(whole).withColumn("asks", F.lit(False))
    dealt = edits.unionByName(ask).repartition("key", "block").sortWithinPartitions("key", "block", "asks", "best")
    return map_arrow(dealt, _answer, f"key {versions.schema['key'].dataType.simpleString()}, asked long, best {kind.simpleString()}")


def feature_as_of(labels: DataFrame, versions: DataFrame, key: str, at: str, event: str, arrival: str, expiry: str, version_id: str, carry: Sequence[str] = (), out: str = "winner", bits: int = BLOCK_BITS) -> DataFrame:
    """``labels`` with ``out``: a struct of event, arrival, identifier and carried columns of the version that wins
    for the label's key at its time, or null. Times are whole numbers (of seconds, say)."""
    long = lambda name: F.col(name).cast("long")
    best = F.struct(long(event).alias("event"), long(arrival).alias("arrival"), F.col(version_id).alias("version_id"), *[F.col(c) for c in carry])
    known = long(event).isNotNull() & long(arrival).isNotNull()
    given = versions.where(known).select(F.col(key).alias("key"), F.greatest(long(event), long(arrival)).alias("start"), long(expiry).alias("expiry"), best.alias("best"))
    found = winners(given, labels.select(F.col(key).alias("key"), long(at).alias("asked")), bits)
    found = found.select(F.col("key").alias("_key"), F.col("asked").alias("_asked"), F.col("best").alias(out))
    return labels.join(found.hint("merge"), (labels[key] == F.col("_key")) & (long(at) == F.col("_asked")), "left").drop("_key", "_asked")
