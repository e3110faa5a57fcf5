"""Compressed adjacency of whole graphs, by ranges of rows.

Nodes are the contiguous indices from 0. A range of nodes is one row of the result: its first node, offsets into
its targets (one more than nodes, the first 0), and the targets of its nodes one after the other, ascending. What
edges come before a range, from prefix sums over ranges, turns its offsets into those of the whole, so ranges can
be read by themselves or stitched into the arrays that tensor libraries take. Features are cut into the same
ranges.

A range holds as many nodes as ``nodes`` says; a node with more targets than a range should hold is cut into
parts by position, so that no row grows with the most frequent node. Edges meet by range; nothing is collected.

Defined cases: nodes without edges have equal offsets; repeated edges count once; edges with a null end, or one
outside the nodes, are left out; no nodes give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foliant.shipping import map_arrow
from foliant.storage import materialize

#: Nodes of a range, and targets of a row.
NODES, TARGETS = 65_536, 1 << 20
ROWS = "range long, part int, first long, n_nodes int, offsets array<long>, targets array<long>, before long"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges from edges sorted by range, part, source and target; a row is given out when the next begins."""
    open_, sources, targets = None, [], []

    def row() -> pa.RecordBatch:
        range_, part, first, n = open_
        source = np.concatenate(sources) if sources else np.zeros(0, np.int64)
        target = np.concatenate(targets) if targets else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(source - first, minlength=n)))).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([range_]), pa.array([part], pa.int32()), pa.array([first]), pa.array([n], pa.int32()), pa.array([offsets], pa.list_(pa.int64())), pa.array([target], pa.list_(pa.int64()))], ["range", "part", "first", "n_nodes", "offsets", "targets"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ranges, parts, first, n = (batch.column(c).to_numpy() for c in ("range", "part", "first", "n_nodes"))
        source, target = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "target"))
        cuts = np.flatnonzero(np.concatenate(([True], (ranges[1:] != ranges[:-1]) | (parts[1:] != parts[:-1]), [True]))).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = (int(ranges[a]), int(parts[a]), int(first[a]), int(n[a]))
            if open_ is not None and here[:2] != open_[:2]:
                yield row()
                sources, targets = [], []
            open_ = here
            real = ~np.isnan(source[a:b].astype(float))
            sources.append(source[a:b][real].astype(np.int64))
            targets.append(target[a:b][real].astype(np.int64))
    if open_ is not None:
        yield row()


def compressed(edges: DataFrame, n_nodes: int, left: str, right: str, nodes: int = NODES, most: int = TARGETS) -> DataFrame:
    """Rows ``ROWS`` of the edges between nodes 0 to ``n_nodes - 1``, directed from ``left`` to ``right``.

    A range with more than ``most`` targets has several parts, by the order of its edges.
    """
    spark = edges.sparkSession
    inside = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0) & (F.col(c) < n_nodes)
    kept = edges.where(inside(left) & inside(right)).select(F.col(left).cast("long").alias("source"), F.col(right).cast("long").alias("target")).distinct()
    kept = materialize(kept, "adjacency-edges")
    range_ = F.floor(F.col("source") / nodes)
    # how many parts a range needs; a source's targets are dealt to parts by ranges of their values, counted per cell
    cell = F.floor(F.col("target") * 1024 / n_nodes)
    counts = kept.groupBy(range_.alias("range"), "source", cell.alias("cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("range").orderBy("source", "cell").rowsBetween(Window.unboundedPreceding, -1)
    dealt = counts.withColumn("part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most).cast("int")).select("source", "cell", "part")
    placed = kept.withColumn("cell", cell).join(dealt, ["source", "cell"]).select(range_.alias("range"), "part", "source", "target")
    first = F.col("range") * nodes
    width = F.least(F.lit(nodes), F.lit(n_nodes) - first).cast("int")
    every = spark.range(0, max(0, -(-n_nodes // nodes))).select(F.col("id").alias("range"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("target"))
    rows = placed.unionByName(every).select("range", "part", first.alias("first"), width.alias("n_nodes"), "source", "target")
    rows = rows.repartition("range", "part").sortWithinPartitions("range", "part", "source", "target")
    made = materialize(map_arrow(rows, _assemble, ROWS.removesuffix(", before long")), "adjacency", kept)
    sizes = made.select("range", "part", F.size("targets").cast("long").alias("n"))
    earlier = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return made.join(sums, ["range", "part"]).select("range", "part", "first", "n_nodes", "offsets", "targets", "before")


def edges_of(adjacency: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """``source, target`` of the nodes from ``low`` up to ``high``; ranges that hold none of them are not read."""
    rows = adjacency.where((F.col("first") + F.col("n_nodes") > low) & (F.lit(True) if high is None else F.col("first") < high))
    at = rows.select("first", "offsets", "targets", F.explode(F.sequence(F.lit(0), F.col("n_nodes") - 1)).alias("i"))
    each = at.select((F.col("first") + F.col("i")).alias("source"), F.slice("targets", (F.col("offsets")[F.col("i")] + 1).cast("int"), (F.col("offsets")[F.col("i") + 1] - F.col("offsets")[F.col("i")]).cast("int")).alias("t"))
    found = each.select("source", F.explode("t").alias("target"))
    return found.where((F.col("source") >= low) & (F.lit(True) if high is None else F.col("source") < high))


def feature_blocks(features: DataFrame, index: str, vector: str, nodes: int = NODES) -> DataFrame:
    """``range, first, n_nodes, width, block``: the vectors of a range of nodes as little-endian doubles, row by row.

    Nodes without a vector have zeros. All vectors have one width; others are an error in their task.
    """
    width = features.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector)).alias("w")).first()["w"] or 0
    rows = features.where(F.col(index).isNotNull()).groupBy(F.col(index).cast("long").alias("i")).agg(F.min(vector).alias("v"))
    rows = rows.select(F.floor(F.col("i") / nodes).alias("range"), "i", "v").repartition("range").sortWithinPartitions("range", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, []

        def block() -> pa.RecordBatch:
            n = held[-1][0] - open_ * nodes + 1
            whole = np.zeros((n, width))
            for i, v in held:
                if v is not None:
                    whole[i - open_ * nodes] = v
            return pa.RecordBatch.from_arrays([pa.array([open_]), pa.array([open_ * nodes]), pa.array([n], pa.int32()), pa.array([width], pa.int32()), pa.array([whole.astype("<f8").tobytes()], pa.binary())], ["range", "first", "n_nodes", "width", "block"])

        for batch in batches:
            for range_, i, v in zip(*(batch.column(c).to_pylist() for c in ("range", "i", "v"))):
                if open_ is not None and range_ != open_:
                    yield block()
                    held = []
                open_ = range_
                held.append((i, v))
        if open_ is not None:
            yield block()

    return map_arrow(rows, run, "range long, first long, n_nodes int, width int, block binary")
