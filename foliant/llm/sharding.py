"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries a weight on every shard; a rack or region weighs what
its shards weigh. A key descends the tree: at every level each child draws ``-ln(u) / weight`` from
a hash of key and child, and the smallest draw wins. A child's draw depends on nothing but the key,
the child and its weight, so a change of weights moves keys only into or out of the subtrees whose
weights changed. ``grown`` hangs a new shard below a region of its own: no existing subtree changes
its weight, so rows move into the new shard alone.

Everything is built from SQL functions; the only data sent to all executors are the offsets of the
numbering, at most ``shards * buckets`` rows.

Defined cases: null text has 0 bytes and the CRC of the empty text; a null key is hashed as the
text ``null``; equal keys share a shard, repeated rows get slots of their own; an empty table gives
no rows; columns of the input beyond key and text are left out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Topology = Sequence[Sequence[Sequence[float]]]

#: Five regions of two racks of four shards, all of one weight.
FORTY_SHARDS: Topology = tuple(tuple((1.0,) * 4 for _ in range(2)) for _ in range(5))
#: Groups in which rows of a shard are numbered apart.
SLOT_BUCKETS = 1024
#: Rows of the table of slot offsets up to which it is broadcast.
_BROADCAST_ROWS = 200_000


def grown(topology: Topology, weight: float = 1.0) -> Topology:
    """The tree with one more shard, in a region of its own."""
    return (*topology, ((weight,),))


def shard_count(topology: Topology) -> int:
    return sum(len(rack) for region in topology for rack in region)


def _winner(key: Column, parent: Column | None, weights: Column, children: int) -> Column:
    """Index of the child with the smallest draw; a child without weight never wins."""
    if children == 1:
        return F.lit(0)

    def draw(i: Column) -> Column:
        node = i.cast("string") if parent is None else F.concat(parent, F.lit("/"), i.cast("string"))
        digits = F.substring(F.md5(F.concat(key, F.lit("|"), node)), 1, 13)
        unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
        score = F.when(weights[i] > 0, -F.log(unit) / weights[i]).otherwise(F.lit(float("inf")))
        return F.struct(score.alias("score"), i.alias("at"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(children - 1)), draw))["at"]


def _bind(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``: computed once, wherever it is used."""
    return F.transform(F.array(value), body)[0]


def place(df: DataFrame, key: Column, topology: Topology, out: str) -> DataFrame:
    """Add ``out``: the shard of each key, numbered depth first from 0."""
    racks, width = max(map(len, topology)), max(len(rack) for region in topology for rack in region)
    padded = [[[float(w) for w in rack] + [0.0] * (width - len(rack)) for rack in region] + [[0.0] * width] * (racks - len(region)) for region in topology]
    first, base = [], 0
    for region in topology:
        starts = []
        for rack in region:
            starts.append(base)
            base += len(rack)
        first.append(starts + [0] * (racks - len(starts)))
    literal = lambda rows: F.array(*[literal(r) if isinstance(r, list) else F.lit(r) for r in rows])
    weights = literal(padded)
    region_weights = literal([float(sum(map(sum, r))) for r in padded])
    rack_weights = literal([[sum(r) for r in region] for region in padded])

    def within(text: Column, region: Column, rack: Column) -> Column:
        parent = F.concat(region.cast("string"), F.lit("/"), rack.cast("string"))
        return literal(first)[region][rack] + _bind(weights[region][rack], lambda w: _bind(parent, lambda p: _winner(text, p, w, width)))

    def descend(text: Column) -> Column:
        return _bind(_winner(text, None, region_weights, len(topology)), lambda region: _bind(_bind(rack_weights[region], lambda w: _winner(text, region.cast("string"), w, racks)), lambda rack: within(text, region, rack)))

    return df.withColumn(out, _bind(F.coalesce(key.cast("string"), F.lit("null")), descend).cast("int"))


def assign_shards(docs: DataFrame, topology: Topology = FORTY_SHARDS, key: str = "doc_id", text: str = "text", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Shard, slot and shard after growth of every row, with its size and checksum.

    Slots number a shard's rows without gaps. Rows of a shard are dealt to ``buckets`` groups by key;
    a row's slot is what the groups before it hold plus its place in its group, so no task sees a
    whole shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(keyed, F.lit("#slot"))), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        bucket.alias("_bucket"),
    )
    rows = place(place(rows, F.col("doc_id"), topology, "shard"), F.col("doc_id"), grown(topology), "grown_shard")
    held = place(docs.select(F.col(key).alias("doc_id"), bucket.alias("_bucket")), F.col("doc_id"), topology, "shard").groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(inside))
    # at most shards * buckets rows, whatever the input
    offsets = F.broadcast(offsets) if shard_count(topology) * buckets <= _BROADCAST_ROWS else offsets
    return numbered.join(offsets, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard"
    )
