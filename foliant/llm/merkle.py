"""Merkle manifest of a dataset by supersteps over RDDs of vertices.

A leaf is the digest of a row's fields. Leaves of a group, in order, are the lowest level of the group's tree;
every 16 neighbours have a parent whose digest is that of their digests. The groups' roots are the leaves of one
more tree, whose root is the dataset's.

A vertex is named by its group's number, its level and its position. In a superstep every vertex of a level
sends its digest to its parent; a parent that has heard all its children hashes them, and is active in the next
superstep. Roots fall silent. The runs of children that a parent has heard are written in every superstep, which
also cuts the lineage. Then the supersteps go back: a vertex that knows its path, the runs on its way to the
root, sends it on to the vertices below with its own run on top, down to the parents of leaves. Those meet their
leaves, and every leaf's proof, and the root that follows from a changed leaf, are computed where the path is:
one path serves 16 leaves.

Leaves are numbered within groups by a range sort: a row's position is what the partitions before hold of its
group, plus its place in its own. A group with most of the rows is many partitions, and a vertex never hears more
than 16 messages. Levels shrink to a sixteenth, so all supersteps together move little more than the first.

Defined cases: null fields are ``-``; rows are ordered by id, null first, then by leaf, so repeated rows are
neighbours with leaves of their own; a null group is a group and comes first; a lone leaf is its group's root;
an empty table gives no rows; columns beyond the fields are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.shipping import ship
from foliant.storage import materialize, parts_for, shared_dir

FAN = 16
#: Bytes of a leaf's row, roughly; sizes the number of partitions.
ROW_BYTES = 256


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, group: str | None, order: Sequence[str], name: str, parts: int) -> DataFrame:
    """``df`` with its rows' positions within groups (``_at``) and the groups' sizes (``_n``). The sorted rows are written, as their partitions must stay."""
    keys = ([group] if group else []) + list(order)
    nulls_first = [F.col(c).asc_nulls_first() for c in keys]
    ordered = df.repartitionByRange(parts, *nulls_first).sortWithinPartitions(*nulls_first).withColumn("_row", F.monotonically_increasing_id())
    ordered = materialize(ordered, name)
    part = F.shiftright("_row", 33)
    by = [F.col(group).alias("_group")] if group else [F.lit(None).cast("string").alias("_group")]
    held = ordered.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_held"), F.min("_row").alias("_first"))  # a row for each partition and group in it
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).withColumn("_n", F.sum("_held").over(whole))
    same = F.col("_group").eqNullSafe(F.col(group)) if group else F.lit(True)
    return ordered.withColumn("_in", part).join(held, same & (F.col("_in") == F.col("_part"))).select(*df.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("_at"), "_n")


class Path(NamedTuple):
    """The way from a vertex to the root: of every run on it the vertex's slot and all digests, lowest first."""

    root: bytes
    subroot: bytes | None
    steps: tuple[tuple[int, tuple[bytes, ...]], ...]

    def below(self, slot: int, digests: tuple[bytes, ...]) -> Path:
        return self._replace(steps=((slot, digests), *self.steps))


def combined(digests: Sequence[bytes]) -> bytes:
    """The digest of digests as hex text, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def siblings(slot: int, digests: Sequence[bytes]) -> str:
    return b"".join(d for i, d in enumerate(digests) if i != slot).hex()


def folded(digest: bytes, steps: Sequence[tuple[int, Sequence[bytes]]]) -> bytes:
    """The root that follows from a digest and the siblings on its way."""
    for slot, digests in steps:
        digest = combined([*digests[:slot], digest, *digests[slot + 1 :]])
    return digest


def height(leaves: int) -> int:
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def _place(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _send(vertex):
    (group, at), (n, digest, leaves) = vertex
    return (group, at // FAN), (at % FAN, digest, n, leaves)


def _hear(heard):
    """A parent's run, once all its children have been heard."""
    (group, at), messages = heard
    messages = sorted(messages)
    _, _, n, leaves = messages[0]
    if [message[0] for message in messages] != list(range(min(FAN, n - FAN * at))):
        raise ValueError(f"vertex {at} of {group!r} misses children")
    return (group, at), (n, tuple(message[1] for message in messages), leaves)


def _parent(heard):
    key, (n, digests, leaves) = heard
    return key, (-(-n // FAN), combined(digests), leaves)


def _is_root(vertex) -> bool:
    return vertex[1][0] == 1


def _is_not_root(vertex) -> bool:
    return vertex[1][0] > 1


def ascend(leaves: RDD, most: int, parts: int, folder: str) -> tuple[list[RDD], RDD]:
    """Supersteps from ``((group, position), (vertices of the level, digest, leaves of the group))`` to the roots of
    trees of up to ``most`` leaves.

    Gives the runs heard by the parents of every level, from the lowest, and the roots, of one vertex a level.
    """
    runs, roots, active = [], [leaves.filter(_is_root)], leaves
    for level in range(1, height(most) + 1):
        path = f"{folder}/level-{level}"
        size = max(1, parts // FAN ** (level - 1))
        active.filter(_is_not_root).map(_send).groupByKey(size, _place).coalesce(size).map(_hear).saveAsPickleFile(path)
        runs.append(leaves.context.pickleFile(path))
        active = runs[-1].map(_parent)
        roots.append(active.filter(_is_root))
    return runs, leaves.context.union(roots)


def _pass_down(met):
    """Children of a vertex with their paths; the vertex's own path has come from above."""
    (group, at), (paths, heard) = met
    runs = [digests for _, digests, _ in heard]
    for path in paths:
        for digests in runs:
            for slot in range(len(digests)):
                yield (group, FAN * at + slot), path.below(slot, digests)


def descend(runs: list[RDD], tops: RDD, parts: int, to: int) -> RDD:
    """Reverse supersteps: from ``(group, (size, path of its root))`` to paths of the vertices of level ``to``,
    ``((group, position), path)``. Trees that are lower than that are left out."""

    def at_top(level: int) -> RDD:
        return tops.filter(lambda top: height(top[1][0]) == level).map(lambda top: ((top[0], 0), top[1][1]))

    known = at_top(len(runs)) if len(runs) >= to else tops.filter(lambda _: False)
    for level in range(len(runs), to, -1):
        size = max(1, parts // FAN**level)
        known = known.cogroup(runs[level - 1], numPartitions=size).coalesce(size).flatMap(_pass_down).union(at_top(level - 1))
    return known


def _meeting(row) -> tuple:
    """A leaf at its parent, or, alone in its group, at itself (level 0)."""
    group, doc_id, leaf, changed, at, n = row
    key = (group, at // FAN, 1) if n > 1 else (group, 0, 0)
    return key, (at % FAN, doc_id, bytes.fromhex(leaf), changed and bytes.fromhex(changed))


def _verify(met):
    """The rows of the leaves below a vertex, by its path."""
    (_, _, level), (leaves, paths) = met
    leaves, (path,) = sorted(leaves, key=lambda x: x[0]), paths
    digests = tuple(leaf for _, _, leaf, _ in leaves)
    above = "".join(siblings(*step) for step in path.steps)
    for slot, doc_id, leaf, changed in leaves:
        own = ((slot, digests),) if level else ()
        proof = hashlib.sha256(((siblings(slot, digests) if level else "") + above).encode()).hexdigest()
        root = folded(changed or leaf, (*own, *path.steps))
        yield doc_id, leaf.hex(), path.subroot.hex(), path.root.hex(), proof, root.hex(), root == path.root


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``tampered`` gives other values for some fields; rows ``where`` it holds are verified with these.
    """
    spark = docs.sparkSession
    ship(spark)
    columns = [F.col(c) for c in fields]
    changed = [(tampered or {}).get(c, F.col(c)) for c in fields]
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(doc_id).alias("doc_id"), leaf_digest(columns).alias("leaf"), F.when(F.lit(False) if where is None else where, leaf_digest(changed)).alias("changed"))
    parts = parts_for(spark, docs.count() * ROW_BYTES)
    rows = materialize(numbered(leaves, "grp", ["doc_id", "leaf"], "merkle-leaves", parts), "merkle-numbered", parts=parts)
    most = rows.agg(F.max("_n")).first()[0]
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if most is None:
        return spark.createDataFrame([], schema)
    folder = f"{shared_dir(spark)}/merkle-runs-{uuid.uuid4().hex}"
    rows = rows.select("grp", "doc_id", "leaf", "changed", "_at", "_n").rdd.map(tuple)
    runs, roots = ascend(rows.map(lambda r: ((r[0], r[4]), (r[5], bytes.fromhex(r[2]), r[5]))), most, parts, f"{folder}/groups")

    fewer = max(1, parts // FAN)
    subroots = spark.createDataFrame(roots.coalesce(fewer).map(lambda v: (v[0][0], v[1][2], v[1][1])), "grp string, size long, digest binary")
    subroots = numbered(materialize(subroots, "merkle-subroots"), None, ["grp"], "merkle-groups", fewer)
    places = materialize(subroots, "merkle-places", parts=fewer).rdd.map(tuple)  # group, size, digest, position, number of groups
    groups = places.first()[4]
    top_runs, tops = ascend(places.map(lambda r: (("", r[3]), (r[4], bytes(r[2]), r[4]))), groups, fewer, f"{folder}/top")
    ((_, (_, root, _)),) = tops.collect()  # one vertex
    found = descend(top_runs, spark.sparkContext.parallelize([("", (groups, Path(root, None, ())))], 1), fewer, 0)
    known = places.map(lambda r: (("", r[3]), (r[0], r[1], bytes(r[2])))).join(found, numPartitions=fewer).coalesce(fewer)
    known = known.map(lambda x: (x[1][0][0], (x[1][0][1], x[1][1]._replace(subroot=x[1][0][2]))))

    paths = descend(runs, known, parts, 1).map(lambda x: ((*x[0], 1), x[1]))
    lone = known.filter(lambda x: x[1][0] == 1).map(lambda x: ((x[0], 0, 0), x[1][1]))
    met = rows.map(_meeting).cogroup(paths.union(lone), numPartitions=parts).coalesce(parts)
    return spark.createDataFrame(met.flatMap(_verify), schema, verifySchema=False)
