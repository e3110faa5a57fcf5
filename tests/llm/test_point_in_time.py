"""The feature join against a plain scan, and the tree against a plain set."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import point_in_time as P


def test_earlier_roots_stay():
    rng = random.Random(3)
    for slots in (1, 2, 3, 37):
        tree, active, seen = P.ActiveVersions(slots), set(), {}
        for time in range(0, 400, 3):
            slot = rng.randrange(slots)
            tree.edit(time, slot, -1 if slot in active else 1)
            active ^= {slot}
            seen[time] = max(active, default=None)
        for time, best in seen.items():
            assert tree.greatest(time) == tree.greatest(time + 2) == best
        assert tree.greatest(-1) is None


@pytest.mark.parametrize("bits", [0, 1, 3, 8])
def test_parts_and_nodes_are_the_version(spark, bits):
    rng = random.Random(bits)
    rows = [(s, s + rng.choice((1, 2, 7, 50, 300, 3000))) for s in (rng.randrange(-500, 5000) for _ in range(200))]
    df = spark.createDataFrame(rows, "s long, e long")
    levels = (3000 >> bits).bit_length()
    for r in df.select("s", "e", P._parts(F.col("s"), F.col("e"), bits).alias("p"), P._covered(F.col("s"), F.col("e"), bits, levels).alias("n")).collect():
        times = Counter(t for p in r.p for t in range(p.begins, p.ends))
        assert all(p.begins >> bits == p.block == (p.ends - 1) >> bits and p.ends - p.begins < 1 << bits for p in r.p)
        for n in r.n:
            times.update(range(n.node << (n.level + bits), (n.node + 1) << (n.level + bits)))
        assert times == Counter(range(r.s, r.e)) and len(r.p) <= 2


VERSIONS = "grp string, event long, arrival long, expiry long, id long, note string, winner string"


def plain_join(labels, versions):
    out = []
    for n, k, t in labels:
        usable = [v for v in versions if k is not None and t is not None and v[0] == k and None not in v[1:4] and v[1] <= t and v[2] <= t < v[3]]
        best = max(usable, key=lambda v: (v[1], v[2], v[4], v[5] is not None, v[5] or ""), default=None)
        out.append((n, best and (best[1], best[2], best[4], best[5])))
    return Counter(out)


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_against_a_scan(spark, bits):
    rng = random.Random(11)
    versions = []
    for i in range(600):
        event = rng.randrange(3000)
        versions.append((rng.choice(("hot", "hot", "a", None)), event, event + rng.randrange(-60, 200), event + rng.choice((0, 1, 5, 90, 900, 2500)), i // 2, rng.choice((None, "é", "x" * 100)), "w"))
    versions += [("hot", None, 1, 2, 5, "n", "w"), ("hot", 7, None, 9, 5, "n", "w"), ("hot", 7, 1, None, 5, "n", "w"), *versions[:50]]
    labels = [(i, rng.choice(("hot", "a", "none", None)), rng.choice((None, rng.randrange(-10, 6000), rng.randrange(3000), 1500))) for i in range(400)]
    asks = spark.createDataFrame(labels, "n long, grp string, t long").withColumn("best", F.lit(1)).withColumn("key", F.lit(2))
    found = P.feature_as_of(asks, spark.createDataFrame(versions, VERSIONS), "grp", "t", "event", "arrival", "expiry", "id", ["note"], bits=bits)
    assert found.columns == ["n", "grp", "t", "best", "key", "winner"]
    assert Counter((r.n, r.winner and tuple(r.winner)) for r in found.collect()) == plain_join(labels, versions)


def test_empty_tables(spark):
    none = spark.createDataFrame([], VERSIONS)
    asks = spark.createDataFrame([(1, "a", 5)], "n long, grp string, t long")
    assert [tuple(r) for r in P.feature_as_of(asks, none, "grp", "t", "event", "arrival", "expiry", "id").collect()] == [(1, "a", 5, None)]
    assert P.feature_as_of(asks.where("false"), none, "grp", "t", "event", "arrival", "expiry", "id").collect() == []


def test_nothing_is_broadcast(spark):
    asks = spark.createDataFrame([(1, "a", 5)], "n long, grp string, t long")
    versions = spark.createDataFrame([("a", 1, 2, 9, 1, "n", "w")], VERSIONS)
    found = P.feature_as_of(asks, versions, "grp", "t", "event", "arrival", "expiry", "id")
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
