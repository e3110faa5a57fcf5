"""Column functions over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null where a vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def mean_vectors(df: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of the vectors of each key: ``sum(w * v) / sum(w)`` by component, in order.

    Components are summed by (key, position) with map-side combining; no group of vectors is collected.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    parts = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), w.alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
    sums = parts.groupBy("_key", "_pos").agg(F.try_divide(F.sum(F.col("_w") * F.col("_x").cast("double")), F.sum("_w")).alias("_mean"))
    listed = sums.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))).alias("_all"))
    return listed.select(F.col("_key").alias(key), F.transform("_all", lambda x: x["_mean"]).alias(vector))


def mean_vector(df: DataFrame, vector: str, dimensions: int = 768) -> DataFrame:
    """The unweighted mean of all vectors as one row; zeros where there are none."""
    means = mean_vectors(df.select(F.lit(1).alias("_all"), vector), "_all", vector)
    one = df.sparkSession.range(1).select(F.lit(1).alias("_all"))
    return one.join(means, "_all", "left").select(F.coalesce(vector, F.array_repeat(F.lit(0.0), dimensions)).alias(vector))
