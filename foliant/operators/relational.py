"""Joins, deduplication and set operations with checked or stated semantics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

#: Rows of a lookup table up to which it is sent to all executors.
BROADCAST_ROWS = 500_000


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with a lookup table, broadcast if its counted rows allow; misses give nulls."""
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    return df.join(table, list(on), "left")


def require(df: DataFrame, problem: Column, message: str) -> DataFrame:
    """Raises when a row meets ``problem``, as the rows are read."""
    return df.where(F.when(F.coalesce(problem, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def one_to_one(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join that raises when a key occurs twice on either side."""
    def checked(df: DataFrame) -> DataFrame:
        counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(on)))
        return require(counted, F.col("_n") > 1, f"key {on} occurs more than once").drop("_n")

    return checked(left).join(checked(right), on, how)


def exactly_one(probe: DataFrame, build: DataFrame, on: str) -> DataFrame:
    """Each probe row with its one match in ``build``; no match or several raise."""
    counts = build.groupBy(on).agg(F.count("*").alias("_n"))
    matched = probe.join(counts, on, "left")
    matched = require(matched, F.coalesce("_n", F.lit(0)) != 1, f"a row without exactly one match by {on}").drop("_n")
    return matched.join(build, on)


def not_done(items: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return items.join(done.select(*on), list(on), "left_anti")


def already_done(items: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return items.join(done.select(*on), list(on), "left_semi")


def new_rows(items: DataFrame, existing: DataFrame, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not stored yet, restricted to allowed keys."""
    rows = items.join(existing.select(key), key, "left_anti")
    return rows if allowed is None else rows.join(allowed.select(key), key, "left_semi")


def zipped(left: DataFrame, right: DataFrame, index: str = "idx") -> DataFrame:
    """Rows of equal index side by side; an index on one side alone raises."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), index, "full_outer")
    return require(both, F.col("_l").isNull() | F.col("_r").isNull(), "the sides have different lengths").drop("_l", "_r")


def merged_results(requests: DataFrame, results: DataFrame, errors: DataFrame, on: str = "custom_id") -> DataFrame:
    """Each request with a status: its result, else its error, else a parsing error."""
    joined = requests.join(results.withColumnRenamed("result", "_result"), on, "left").join(errors.withColumnRenamed("error", "_error"), on, "left")
    status = F.when(F.col("_result").isNotNull(), "success").when(F.col("_error").isNotNull(), "judge_error").otherwise("parsing_error")
    return joined.select(*requests.columns, status.alias("status"), F.col("_result").alias("result"), F.when(F.col("_result").isNull(), F.col("_error")).alias("error"))


def _best(df: DataFrame, by: Sequence[Column | str], order: Column, last: bool) -> DataFrame:
    """The whole first or last row of each group, combined on the map side before rows move."""
    choose = F.max_by if last else F.min_by
    chosen = df.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(choose(F.struct(*[F.col(c) for c in df.columns]), order).alias("_row"))
    return chosen.select("_row.*")


def first_by_content(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each distinct text; texts meet by their digest."""
    return _best(df, [F.sha2(F.coalesce(F.col(text), F.lit("")), 256), F.col(text).isNull()], F.struct(F.col(order)), last=False)


def repeated_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once, with the group's size; null keys are a group."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_members")).where("n_members > 1")
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_members")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(counts, same).select(*df.columns, "n_members")


def latest(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key; nulls of the order come first."""
    return _best(df, [key], F.struct(*order), last=True)


def longest_per_group(df: DataFrame, group: Sequence[str], text: str, position: str) -> DataFrame:
    """The longest text of each group, the first of equally long ones.

    Only lengths and positions are compared; whole rows move once they are chosen.
    """
    place = F.struct(F.coalesce(-F.length(text), F.lit(1)).alias("l"), F.col(position).alias("p"))
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in group]).agg(F.min(place).alias("_best"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in group]
    return df.join(best, [*same, F.col(position).eqNullSafe(F.col("_best.p")), F.coalesce(-F.length(text), F.lit(1)) == F.col("_best.l")]).select(*df.columns)


def tail_uniform(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Whether the last ``n`` values of each key are equal, and the latest ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(value))
    last = df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n)
    return last.groupBy(key).agg((F.count_distinct(value) == 1).alias("uniform"), F.max(order).alias("latest"), F.count("*").alias("n_checked"))


def sizes_of(steps: Mapping[str, DataFrame]) -> DataFrame:
    """``step, n, change``: rows after each step and against the step before it."""
    names = list(steps)
    counted = None
    for at, (name, df) in enumerate(steps.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(at).alias("_at"), F.lit(name).alias("step"), "n")
        counted = one if counted is None else counted.unionByName(one)
    before = F.lag("n").over(Window.orderBy("_at"))  # a row a step
    return counted.select("step", "n", (F.col("n") - before).alias("change")) if names else counted


def stepped(df: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, Callable[[], list[tuple[str, int, int | None]]]]:
    """A table after some steps, and a function that tells ``step, n, change`` of each once the result has been written.

    Rows are counted as they pass, in the job that makes the result: no step is run again to be counted.
    """
    seen: list[tuple[str, Observation]] = []
    for name, step in steps.items():
        watch = Observation(name)
        df = step(df).observe(watch, F.count(F.lit(1)).alias("n"))
        seen.append((name, watch))

    def told() -> list[tuple[str, int, int | None]]:
        sizes = [(name, watch.get["n"]) for name, watch in seen]
        return [(name, n, n - sizes[at - 1][1] if at else None) for at, (name, n) in enumerate(sizes)]

    return df, told


def ordered_values(df: DataFrame, key: str, order: str, value: str, out: str = "values") -> DataFrame:
    """Values of each key as a list in ``order``."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))


def missing_days(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Days between two dates, both included, on which ``df`` has no row."""
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.join(df.select(F.col(day).cast("date").alias("day")).distinct(), "day", "left_anti")


def snapshot_overlap(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys in both snapshots and in one alone, with shares."""
    both = old.select(key).distinct().withColumn("_o", F.lit(1)).join(new.select(key).distinct().withColumn("_n", F.lit(1)), key, "full_outer")
    counts = both.agg(F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("n_both"), F.count_if(F.col("_n").isNull()).alias("n_old_only"), F.count_if(F.col("_o").isNull()).alias("n_new_only"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a) * 1.0, F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return counts.withColumns({"new_share_of_new": share("n_new_only", "n_both"), "lost_share_of_old": share("n_old_only", "n_both")})


def upserted(stored: DataFrame, changes: DataFrame, key: str, present: Mapping[str, str] | None = None) -> DataFrame:
    """Field-level upsert: a changed row replaces only the fields that it supplies, explicit nulls included.

    ``present`` names, by field, a boolean column of ``changes`` that says whether the field is supplied;
    without it all columns of ``changes`` are. Unknown keys are inserted. The last of several changes must
    be chosen before (``latest``).
    """
    present = present or {}
    fields = [c for c in changes.columns if c != key and c not in present.values()]
    new = changes.select(F.col(key), F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in fields], *[F.col(p).alias(f"_has_{c}") for c, p in present.items()])
    joined = stored.join(new, key, "full_outer")
    out = [F.col(key)]
    for c in [*[x for x in stored.columns if x != key], *[f for f in fields if f not in stored.columns]]:
        old = F.col(c) if c in stored.columns else F.lit(None)
        if c not in fields:
            out.append(old.alias(c))
            continue
        supplied = F.coalesce(F.col("_changed"), F.lit(False)) & (F.coalesce(F.col(f"_has_{c}"), F.lit(False)) if c in present else F.lit(True))
        out.append(F.when(supplied, F.col(f"_new_{c}")).otherwise(old).alias(c))
    return joined.select(*out)


def union_of(*tables: DataFrame) -> DataFrame:
    """Rows of any of the tables, once each."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out.distinct()


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows but those with a listed key."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A reproducible sample of ``n`` rows by hash of the key, in key order; all rows if there are no more."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), key).limit(n).orderBy(key)


def fraction(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """A reproducible share of the rows, by hash of the key; rows keep their place."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"#{seed}"))), 1, 13), 16, 10).cast("long")
    return df.where(digits < int(share * 16**13))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), key)


def by_length(df: DataFrame, text: str, index: str) -> DataFrame:
    """Longest texts first, equally long ones in order of ``index``, which brings the old order back."""
    return df.orderBy(F.coalesce(F.length(text), F.lit(0)).desc(), index)


def restored(df: DataFrame, index: str) -> DataFrame:
    """Rows of ``by_length``, or results of them, in their old order."""
    return df.orderBy(index)


def pages_up_to(df: DataFrame, most: int, page: int, order: Sequence[Column | str]) -> DataFrame:
    """Whole pages of ``page`` rows until ``most`` rows are reached; the last page may go beyond."""
    return df.orderBy(*order).limit(-(-most // page) * page)


def page_at(df: DataFrame, offset: int, limit: int, order: Sequence[Column | str]) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def side_by_side(tables: Mapping[str, DataFrame], on: str) -> DataFrame:
    """All rows of the first table with those of the others, every column but the key under the suffix of its table."""
    out = None
    for suffix, df in tables.items():
        renamed = df.select(on, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c != on])
        out = renamed if out is None else out.join(renamed, on, "left")
    return out


def across(df: DataFrame, index: Sequence[str], column: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per index and one column per name, aligned by the index; cells without a value are null."""
    return df.groupBy(*index).pivot(column, list(names)).agg(F.first(value, ignorenulls=True))


def flattened(df: DataFrame, nested: str) -> DataFrame:
    """A struct column's fields beside the other columns."""
    return df.select(*[c for c in df.columns if c != nested], f"{nested}.*")


def updated_by(stored: DataFrame, update: Callable[[DataFrame], DataFrame], key: str, where: Column | None = None) -> DataFrame:
    """Stored rows after an update function saw some of them; it returns the key and the fields it changes."""
    return upserted(stored, update(stored if where is None else stored.where(where)), key)


def inserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows and those new ones whose key is not stored, the first of a repeated key; absent fields are null."""
    fresh = new.join(stored.select(key), key, "left_anti")
    fresh = _best(fresh, [key], F.struct(*[F.col(c) for c in fresh.columns]), last=False)
    return stored.unionByName(fresh.select(*[c for c in fresh.columns if c in stored.columns]), allowMissingColumns=True)


def checked_after(df: DataFrame, key: str, at: str, value: str, days: int, now: Column) -> DataFrame:
    """The last check of each key: its value, and whether it is not older than some days."""
    last = latest(df.select(key, at, value), key, [at, value])
    return last.withColumn("recent", F.col(at) > now - F.make_dt_interval(F.lit(days)))
