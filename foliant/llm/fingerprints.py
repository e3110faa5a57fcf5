"""Document fingerprints by a threshold-scaled sketch.

The sketch of a text is the set of all hashes of its shingles of five words that fall below a fixed
fraction of the hash range. Sketches of any two texts can be merged by union, and intersections
estimate resemblance and containment whatever the sizes of the texts. A text without a hash below the
fraction has few shingles; all its hashes are kept apart as its rest. The rest tells such texts from
each other and compares them exactly, and never meets the hashes of a sketch: merging drops it as soon
as there is a hash below the fraction, so a merged sketch is that of the texts taken together.

A hash is the first 16 hex digits of the MD5 of the shingle, its words joined by one space; below
the fraction means that the digits sort before ``threshold``. SQL functions only.

Defined cases: null text counts as empty; an empty text has the empty fingerprint, which is like
another empty one (1.0) and unlike all others (0.0); a text of under five words is one shingle;
rows that share an id are ordered by text; the last row's next is the first, and a single row is its own next.
Rows without an id have no place in the order: they are their own next. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.storage import materialize

SHINGLE = 5
#: One eighth of all hashes start with a digit below this.
THRESHOLD = "2"
_DIGITS = 16
#: Neighbouring ids form groups by their high bits: the most low bits out of these with which no group has
#: more rows than ``GROUP_ROWS``; with the fewest a group has at most 512 ids.
_LOW_BITS = range(9, 62, 4)
GROUP_ROWS = 4096
#: Groups of a part in which they are put in order.
PART_GROUPS = 1_000_000
#: Rows of the table of group heads up to which it is broadcast (24 bytes each).
_BROADCAST_ROWS = 200_000


def sketch(text: Column, shingle: int = SHINGLE, threshold: str = THRESHOLD) -> Column:
    """``low``: sorted distinct hashes of ``text`` below the threshold; ``rest``: all of them, where none is below."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    digest = lambda joined: F.substring(F.md5(joined), 1, _DIGITS)
    none = F.array().cast("array<string>")

    def hashes(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - shingle), lambda i: digest(F.concat_ws(" ", *[ws[i + j] for j in range(shingle)])))
        return F.when(F.size(ws) >= shingle, each).when(F.size(ws) > 0, F.array(digest(F.array_join(ws, " ")))).otherwise(none)

    def retained(hs: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(hs, lambda h: h < threshold)))
        rest = F.when(F.exists(hs, lambda h: h < threshold), none).otherwise(F.array_sort(F.array_distinct(hs)))
        return F.struct(low.alias("low"), rest.alias("rest"))

    # bound as lambda variables: evaluated once per text, not once per shingle
    return F.transform(F.transform(F.array(words), hashes), retained)[0]


def likeness(a: Column, b: Column) -> Column:
    """Resemblance, 0 to 1: estimated from the sketches, exact where neither text has a hash below the threshold."""
    some = (F.size(a["low"]) > 0) | (F.size(b["low"]) > 0)
    x, y = F.when(some, a["low"]).otherwise(a["rest"]), F.when(some, b["low"]).otherwise(b["rest"])
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` contains, 0 to 1: estimated from the sketch of ``a``; where that is empty, exact
    against another text without a sketch, and else null, as the sketch of ``b`` says nothing about it."""
    low, rest = a["low"], a["rest"]
    exact = F.when(F.size(rest) == 0, 1.0).when(F.size(b["low"]) == 0, F.size(F.array_intersect(rest, b["rest"])) / F.size(rest))
    return F.when(F.size(low) > 0, F.size(F.array_intersect(low, b["low"])) / F.size(low)).otherwise(exact)


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts taken together."""
    low = F.array_sort(F.array_union(a["low"], b["low"]))
    rest = F.when(F.size(low) > 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_union(a["rest"], b["rest"])))
    return F.struct(low.alias("low"), rest.alias("rest"))


def shown(a: Column) -> Column:
    """A sketch as a string; a rest starts with a tilde."""
    return F.when(F.size(a["rest"]) > 0, F.concat(F.lit("~"), F.array_join(a["rest"], ","))).otherwise(F.array_join(a["low"], ","))


def low_bits(ids: DataFrame, group_rows: int = GROUP_ROWS) -> int:
    """Low bits of ``_id`` that neighbours share, from exact counts of rows."""
    best = _LOW_BITS[0]
    for bits in _LOW_BITS[1:]:
        most = ids.groupBy(F.shiftright("_id", bits)).count().agg(F.max("count")).first()[0] or 0
        if most > group_rows:
            break
        best = bits
    return best


def _heads(ids: DataFrame, bits: int, part_groups: int = PART_GROUPS) -> DataFrame:
    """First id of every group, with the group before it (of the first: the last).

    Groups are sorted by ranges; a range hands only its last group to the next one.
    """
    groups = ids.groupBy(F.shiftright("_id", bits).alias("_group")).agg(F.min("_id").alias("_head"))
    groups = materialize(groups, "fingerprint-groups")
    parts = 1 + groups.count() // part_groups
    ranged = materialize(groups.repartitionByRange(parts, "_group").withColumn("_part", F.spark_partition_id()), "fingerprint-parts", groups)
    ends = ranged.groupBy("_part").agg(F.max("_group").alias("_last"))  # a row for a million groups
    before = F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_part"))
    ends = ends.select("_part", F.coalesce(before, F.max("_last").over(Window.partitionBy(F.lit(0)))).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_group")
    return ranged.withColumn("_lag", F.lag("_group").over(inside)).join(F.broadcast(ends), "_part").select(F.coalesce("_lag", "_before").alias("_to"), "_head")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text``, its sketch and, by ascending id, the next row's text and sketch.

    Rows are grouped by the high bits of the id; each group also gets the first row of the next group. No
    task orders the whole table. Rows that share an id meet in one group.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select(F.col(doc_id).alias("_id")).where(F.col("_id").isNotNull())
    bits = low_bits(ids)
    heads = materialize(_heads(ids, bits), "fingerprint-heads")
    if heads.count() <= _BROADCAST_ROWS:
        heads = F.broadcast(heads)
    known = rows.where(F.col("doc_id").isNotNull())
    copies = known.join(heads, F.col("doc_id") == F.col("_head")).groupBy("_to", "doc_id").agg(F.min("text").alias("text"))
    grouped = known.select(F.shiftright("doc_id", bits).alias("_group"), F.lit(0).alias("_extra"), "doc_id", "text").unionByName(copies.select(F.col("_to").alias("_group"), F.lit(1).alias("_extra"), "doc_id", "text"))
    grouped = grouped.repartition("_group").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("_group").orderBy("_extra", "doc_id", "text")
    placed = grouped.select("_extra", "doc_id", "text", "sketch", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch")).where("_extra = 0").drop("_extra")
    alone = rows.where(F.col("doc_id").isNull()).withColumn("sketch", sketch(F.col("text")))
    return placed.unionByName(alone.select("doc_id", "text", "sketch", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch")))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last quarter comes from the next text."""
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = with_next(docs, doc_id, text).withColumn("_edited", edited).withColumn("_edited_sketch", sketch(F.col("_edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"),
        shown(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("_edited_sketch")).alias("kept_in_edited"),
    )
