"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target of words and a schedule: its weight in equal phases of the training run.
The integral of the schedule, scaled to the target, is the source's cumulative demand over time.
Documents of a source are laid out in a hashed order; a document that begins after ``c`` words is
trained at the time when the cumulative demand reaches ``c``, which inverts the integral. Sorting by
that position by ranges gives the curriculum.

Only SQL functions are used. A source's running sum is built from sums of hash-ordered buckets, so
a source with a third of all rows is spread over many groups.

Defined cases: null or empty text has size 0 and nothing is taken of it; a null source is a source
of its own, last in order; repeated rows are rows of their own; equal hashes are ordered by id and
size; an empty table gives no rows; further columns are carried along unchanged, but for those
named like a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
#: Weights of a source in equal phases of the run, by its rank: fading, even, growing.
SCHEDULES = ((4.0, 3.0, 2.0, 1.0), (1.0, 1.0, 1.0, 1.0), (1.0, 2.0, 3.0, 4.0))
BUCKET_BITS = 12
_HASH_BITS = 52


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """Targets of the sources in ``sizes(source, source_size)``, one row each.

    The budget is shared by weight; a target stops at ``most`` times its source's size and the rest is
    shared again. Sources sorted by size per weight fill up in that order, so running sums decide which
    of them stop, without rounds. The windows run over one row per source
    in a single task, which suits up to some millions of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("rank") % len(weights)])
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "cap_before": F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)),
    })
    level = (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    ranked = ranked.withColumn("stops", level * F.col("weight") >= F.col("cap"))
    ranked = ranked.withColumns({
        "stopped": F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything),
        "open": F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything),
    })
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.try_divide(F.col("budget") - F.col("stopped"), F.col("open")) * F.col("weight"))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def position_at(share_before: Column, rank: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Time in [0, 1] at which a source's cumulative demand reaches ``share_before`` of its target."""
    chosen = F.lit(None).cast("double")
    for at, phases in reversed(list(enumerate(schedules))):
        total, reached, terms = float(sum(phases)), 0.0, None
        for weight in phases:
            low, reached = reached / total, reached + weight
            done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (share_before - F.lit(low)) / F.lit(weight / total)))
            terms = done if terms is None else terms + done
        chosen = F.when(rank % len(schedules) == at, terms / F.lit(float(len(phases)))).otherwise(chosen)
    return chosen


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, schedules: Sequence[Sequence[float]] = SCHEDULES, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` with its part in the mix.

    Added: ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_taken`` (words, repeats counted),
    ``mix_passes`` (whole passes), ``mix_partial`` (words of one more, cut pass), ``mix_position`` (of
    the first pass, null where nothing is taken) and ``mix_second_position``.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_passes", "mix_partial", "mix_position", "mix_second_position")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long")
    rows = docs.withColumns({"mix_size": size, "_mix_key": key, "_mix_bucket": F.shiftright(key, _HASH_BITS - BUCKET_BITS), "_mix_source": F.col(source)})
    sums = (
        docs.select(F.col(source).alias("source"), F.shiftright(key, _HASH_BITS - BUCKET_BITS).alias("bucket"), size.alias("size"))
        .groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    )
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    plan = (
        offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select(F.col("o.source").alias("_plan_source"), F.col("bucket").alias("_plan_bucket"), F.col("offset").alias("_plan_offset"), F.col("source_size").alias("mix_source_size"), F.col("rank").alias("_plan_rank"), F.col("target").alias("mix_target"))
    )
    inside = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_key", doc_id, "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_inside", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    joined = rows.join(plan, F.col("_mix_source").eqNullSafe(F.col("_plan_source")) & (F.col("_mix_bucket") == F.col("_plan_bucket")))
    start = F.col("_plan_offset") + F.col("_mix_inside")
    budget = F.floor("mix_target").cast("long")
    passes = F.least(F.lit(most), F.coalesce(F.floor(F.try_divide(budget, F.col("mix_source_size"))), F.lit(0))).cast("int")
    joined = joined.withColumn("_mix_start", start).withColumn("mix_passes", F.when(F.col("mix_size") > 0, passes).otherwise(0))
    left = budget - passes.cast("long") * F.col("mix_source_size")
    joined = joined.withColumn("mix_partial", F.greatest(F.lit(0), F.least(F.col("mix_size"), left - F.col("_mix_start"))).cast("long"))
    joined = joined.withColumn("mix_taken", (F.col("mix_passes") * F.col("mix_size") + F.col("mix_partial")).cast("long"))
    first = position_at(F.try_divide(F.col("_mix_start"), F.col("mix_target")), F.col("_plan_rank"), schedules)
    second = position_at(F.try_divide(F.col("_mix_start") + F.col("mix_source_size"), F.col("mix_target")), F.col("_plan_rank"), schedules)
    repeats = F.col("mix_passes") + F.when(F.col("mix_partial") > 0, 1).otherwise(0)
    return joined.withColumns({
        "mix_position": F.when(F.col("mix_taken") > 0, first),
        "mix_second_position": F.when(repeats > 1, second),
    }).drop("_mix_key", "_mix_bucket", "_mix_source", "_mix_inside", "_mix_start", "_plan_source", "_plan_bucket", "_plan_offset", "_plan_rank")


def mixture_rows(docs: DataFrame, **settings) -> DataFrame:
    """The training order: one row per pass over a document, sorted by position over ranges.

    A cut pass keeps the text up to the end of its last taken word. Columns are those of ``docs``.
    """
    text, doc_id = settings.get("text", "text"), settings.get("doc_id", "doc_id")
    mixed = mix(docs, **settings).where(F.col("mix_taken") > 0)
    full = F.transform(F.sequence(F.lit(1), F.col("mix_passes")), lambda i: F.struct(F.when(i == 1, F.col("mix_position")).otherwise(F.col("mix_second_position")).alias("at"), F.lit(-1).cast("long").alias("words")))
    cut = F.struct(F.when(F.col("mix_passes") == 0, F.col("mix_position")).otherwise(F.col("mix_second_position")).alias("at"), F.col("mix_partial").alias("words"))
    full = F.when(F.col("mix_passes") > 0, full).otherwise(F.array().cast("array<struct<at:double,words:bigint>>"))
    each = F.concat(full, F.when(F.col("mix_partial") > 0, F.array(cut)).otherwise(F.array().cast("array<struct<at:double,words:bigint>>")))
    rows = mixed.withColumn("_mix_pass", F.explode(each))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut_text = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("_mix_pass.words"), F.lit(1)).cast("int")), " ")
    whole = (F.col("_mix_pass.words") < 0) | (F.col("_mix_pass.words") >= F.col("mix_size"))
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(cut_text)).withColumn("_mix_at", F.col("_mix_pass.at"))
    return rows.orderBy("_mix_at", doc_id).select(*docs.columns)
