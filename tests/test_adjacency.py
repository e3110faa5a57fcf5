"""Compressed adjacency and feature blocks: round trips, ranges, hot nodes, stitched offsets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import adjacency as A


def pairs(df):
    return sorted((r.source, r.target) for r in df.collect())


@pytest.mark.parametrize("nodes, most", [(7, 1000), (7, 20), (100, 30), (1, 5)])
def test_round_trip(spark, nodes, most):
    rng = random.Random(nodes)
    edges = {(rng.randrange(50), rng.randrange(60)) for _ in range(200)} | {(3, t) for t in range(60)}
    rows = [*edges, *list(edges)[:20], (None, 1), (1, None), (70, 1), (1, 60), (-1, 2)]
    made = A.compressed(spark.createDataFrame(rows, "u long, v long").withColumn("range", F.lit("clash")), 60, "u", "v", nodes, most)
    assert pairs(A.edges_of(made)) == sorted(edges)
    assert pairs(A.edges_of(made, 3, 10)) == sorted(e for e in edges if 3 <= e[0] < 10)
    told = made.orderBy("range", "part").collect()
    assert {(r.first, r.n_nodes) for r in told} == {(f, min(nodes, 60 - f)) for f in range(0, 60, nodes)}
    stitched = [r.before + r.offsets[-1] for r in told]
    assert stitched == [r.before for r in told[1:]] + [len(edges)] and all(len(r.targets) <= most + 60 for r in told)
    if most >= 1000:  # the arrays of a tensor library
        offsets = [0, *(r.before + o for r in told for o in r.offsets[1:])]
        targets = [t for r in told for t in r.targets]
        assert [(s, t) for s in range(60) for t in targets[offsets[s] : offsets[s + 1]]] == sorted(edges)


def test_no_nodes_and_no_edges(spark):
    none = spark.createDataFrame([], "u long, v long")
    assert A.compressed(none, 0, "u", "v").collect() == []
    (row,) = A.compressed(none, 3, "u", "v").collect()
    assert (row.first, row.n_nodes, row.offsets, row.targets, row.before) == (0, 3, [0, 0, 0, 0], [], 0)


def test_features(spark):
    rows = [(i, [float(i), 0.5]) for i in range(10) if i != 4] + [(7, [7.0, 0.5]), (None, [1.0, 1.0]), (3_000, None)]
    blocks = A.feature_blocks(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", 4).orderBy("range").collect()
    whole = np.zeros((10, 2))
    for b in blocks[:3]:
        whole[b.first : b.first + b.n_nodes] = np.frombuffer(b.block, "<f8").reshape(b.n_nodes, b.width)
    assert whole.tolist() == [[float(i), 0.5] if i != 4 else [0.0, 0.0] for i in range(10)] and blocks[3].first == 3000
