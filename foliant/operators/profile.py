"""Profiling aggregates: counts, shares, distributions, null profiles, contingency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(df: DataFrame, keys: Sequence[str], null_as: str | None = None, drop_null: bool = False, out: str = "n") -> DataFrame:
    """Rows per key, largest first; null keys are kept, dropped or named."""
    if drop_null:
        for key in keys:
            df = df.where(F.col(key).isNotNull())
    if null_as is not None:
        df = df.withColumns({key: F.coalesce(F.col(key).cast("string"), F.lit(null_as)) for key in keys})
    return df.groupBy(*keys).agg(F.count("*").alias(out)).orderBy(F.desc(out), *keys)


def with_share(counts: DataFrame, by: Sequence[str] = (), n: str = "n", out: str = "pct", digits: int = 4) -> DataFrame:
    """Each count's percentage of all counts with equal ``by`` columns."""
    if by:
        total = F.sum(n).over(Window.partitionBy(*by))
        return counts.withColumn(out, F.round(F.col(n) * 100.0 / total, digits))
    whole = counts.agg(F.sum(n).alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(whole)).withColumn(out, F.round(F.col(n) * 100.0 / F.col("_total"), digits)).drop("_total")


def top(df: DataFrame, count: int, n: str = "n", *ties: str) -> DataFrame:
    return df.orderBy(F.desc(n), *ties).limit(count)


def top_and_bottom(df: DataFrame, value: str, key: str, most: int, least: int) -> DataFrame:
    """The largest and the smallest rows, marked; ties by key."""
    high = df.orderBy(F.desc(value), key).limit(most).withColumn("side", F.lit("top"))
    return high.unionByName(df.orderBy(F.asc(value), key).limit(least).withColumn("side", F.lit("bottom")))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """``column, n_null, null_ratio`` in one pass over all columns."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot("_rows", columns, "column", "n_null").select("column", "n_null", F.coalesce(F.round(F.try_divide("n_null", "_rows"), digits), F.lit(0.0)).alias("null_ratio"))


def _at_quantiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Exact, interpolated quantiles ``_q0, _q1, ...`` of each group, from counts of its distinct values.

    Values are counted with map-side combining; running counts tell at which value each of the two ranks
    around a quantile lies, so no group is held in one buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    per = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumns({"_up": F.sum("_n").over(per.orderBy("_v")), "_all": F.sum("_n").over(per)})
    aggregates = []
    for i, level in enumerate(levels):
        rank = (F.col("_all") - 1) * F.lit(float(level))
        low, high = F.floor(rank), F.ceil(rank)
        at = lambda r: F.max(F.when((F.col("_up") - F.col("_n") <= r) & (r < F.col("_up")), F.col("_v").cast("double")))
        aggregates += [at(low).alias(f"_a{i}"), at(high).alias(f"_b{i}"), F.max(rank - low).alias(f"_w{i}")]
    found = counts.groupBy(*by).agg(*aggregates)
    return found.select(*by, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_w{i}")).alias(f"_q{i}") for i in range(len(levels))])


def _joined_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two results of one row a group side by side; null groups meet."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), "left")  # one row each
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in right.columns if c not in by])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by], "left").drop(*[f"_r_{c}" for c in by])


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, minimum, maximum, mean, median and sample deviation (0 for one row)."""
    v = F.col(value)
    stats = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("deviation"))
    both = _joined_by(stats, _at_quantiles(df, value, [0.5], by), by)
    return both.select(*by, "n", "least", "most", "mean", F.round("_q0", 6).alias("median"), "deviation")


def described(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, nulls, mean, sample deviation, minimum, quartiles and maximum in one result."""
    v = F.col(value)
    stats = df.groupBy(*by).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"))
    both = _joined_by(stats, _at_quantiles(df, value, [0.25, 0.5, 0.75], by), by)
    return both.select(*by, "n", "n_null", "mean", "deviation", "least", *[F.round(f"_q{i}", 6).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "most")


def quantiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, interpolated quantiles as columns ``p<level in percent>``."""
    return _at_quantiles(df, value, levels, by).select(*by, *[F.round(f"_q{i}", 6).alias(f"p{round(p * 100)}") for i, p in enumerate(levels)])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n, cumulative`` over equal bins; the last bin includes ``high``, values outside are dropped."""
    inside = df.where(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    order = Window.orderBy("bin")  # at most ``bins`` rows
    return counts.select("bin", "n", F.round(F.sum("n").over(order) / F.sum("n").over(Window.partitionBy()), 6).alias("cumulative"))


def whole_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, low, n, cumulative`` over equal bins from the least to the greatest value; empty bins have rows.

    ``low`` is the bin's lower edge, and the last bin includes the greatest value. Cumulative counts are
    divided by all rows, null ones too. If all values are equal, the bins cover a width of 1 around them.
    Without a value there are no rows.
    """
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("_a"), F.max(v).alias("_b"), F.count(F.lit(1)).alias("_rows")).where("_a is not null")  # one row
    pad = F.when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)
    ends = ends.select((F.col("_a") - pad).alias("_low"), ((F.col("_b") - F.col("_a") + 2 * pad) / bins).alias("_width"), "_rows")
    at = F.least(F.floor((v - F.col("_low")) / F.col("_width")), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends)).join(counts, "bin", "left")
    n, order = F.coalesce("n", F.lit(0)), Window.orderBy("bin")  # ``bins`` rows
    return every.select("bin", F.round(F.col("_low") + F.col("bin") * F.col("_width"), 6).alias("low"), n.alias("n"), F.round(F.sum(n).over(order) / F.col("_rows"), 6).alias("cumulative"))


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct values, duplicates, whether all differ, share of rows whose value occurs once."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(key).alias("n_distinct"), (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("n_duplicates"),
        F.coalesce(F.max("_n") == 1, F.lit(True)).alias("is_unique"), F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)), F.sum("_n")), F.lit(0.0)), 6).alias("unique_share"),
    )


def contingency(df: DataFrame, period: Column, category: str, values: Sequence[str], percent: bool = False) -> DataFrame:
    """Counts of each value by period, zeros filled in; as percentages of the period on request."""
    table = df.groupBy(period.alias("period")).pivot(category, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    if not percent:
        return table
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return table.select("period", *[F.round(F.coalesce(F.try_divide(F.col(f"`{v}`") * 100.0, total), F.lit(0.0)), 4).alias(v) for v in values])


def indicator_rate(df: DataFrame, by: Sequence[str], indicator: Column, out: str = "rate") -> DataFrame:
    """Share of rows with a true indicator, with group sizes."""
    return df.groupBy(*by).agg(F.round(F.avg(F.coalesce(indicator, F.lit(False)).cast("int")), 6).alias(out), F.count("*").alias("n")).orderBy(F.desc(out), *by)


def dimensions(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """``dimension, value, count, percentage`` of several columns in one pass over grouping sets.

    Null and empty values are left out of a dimension and of its total; ties are ordered by value.
    """
    named = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    grouped = named.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("count"), F.grouping_id().alias("_set"))
    width, dimension, value = len(columns), F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, c in enumerate(columns):
        mine = F.col("_set") == (2**width - 1) - 2 ** (width - 1 - at)
        dimension, value = F.when(mine, c).otherwise(dimension), F.when(mine, F.col(c)).otherwise(value)
    rows = grouped.select(dimension.alias("dimension"), value.alias("value"), "count").where(F.col("value").isNotNull() & (F.col("value") != ""))
    per = Window.partitionBy("dimension")
    rows = rows.withColumn("percentage", F.round(F.col("count") * 100.0 / F.sum("count").over(per), 4))
    if most is not None:
        rows = rows.withColumn("_at", F.row_number().over(per.orderBy(F.desc("count"), "value"))).where(F.col("_at") <= most).drop("_at")
    return rows


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("earliest"), F.max(column).alias("latest"), F.count(column).alias("n_dated"))


def years(df: DataFrame, column: str) -> DataFrame:
    """Rows by year; undated rows are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.year(column).alias("year")).agg(F.count("*").alias("n"))


def date_report(df: DataFrame, column: str, samples: int = 5) -> DataFrame:
    """One row: earliest, latest, number of dated rows, counts by year, and the earliest distinct days as a sample."""
    per_year = years(df, column).agg(F.array_sort(F.collect_list(F.struct("year", "n"))).alias("_years"))  # a row a year
    days = df.where(F.col(column).isNotNull()).select(F.to_date(column).alias("day")).distinct().orderBy("day").limit(samples)
    days = days.agg(F.array_sort(F.collect_list("day")).alias("sample"))
    whole = date_range(df, column).join(F.broadcast(per_year), F.lit(True)).join(F.broadcast(days), F.lit(True))
    return whole.select("earliest", "latest", "n_dated", F.map_from_entries("_years").alias("by_year"), "sample")


def response(df: DataFrame, top: dict[str, int], date: str, unique: Sequence[str]) -> DataFrame:
    """One JSON answer: the largest groups of each dimension with percentages, counts by year, distinct values."""
    parts = []
    for name, most in top.items():
        rows = dimensions(df, [name], most).withColumn("percentage", F.bround("percentage", 1))
        parts.append(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "value", "count", "percentage"))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"), x["percentage"].alias("percentage"))).alias(name)))  # ``most`` rows
    parts.append(years(df, date).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), "n")))).alias("by_year")))
    parts.append(df.agg(F.count(F.lit(1)).alias("total"), *[F.count_distinct(c).alias(f"unique_{c}") for c in unique]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(F.broadcast(part), F.lit(True))  # one row each
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("response"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts by gold and predicted value; null is the value ``None``."""
    named = df.select(F.coalesce(F.col(gold).cast("string"), F.lit("None")).alias("gold"), F.coalesce(F.col(predicted).cast("string"), F.lit("None")).alias("_p"))
    return named.groupBy("gold").pivot("_p", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def most_frequent(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent value of each group; ties go to the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column))).alias(column), F.max("_n").alias("n"))
