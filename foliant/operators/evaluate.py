"""Scoring of structured extractions against gold records, and aggregation of scores.

Predictions are rows ``idx, answer, gold`` of JSON texts, fenced or not. A schema maps fields to
``{"type": ..., "choices": [...], "required": bool}``. Scores come as rows ``idx, field, metric, value``.
A key that the prediction lacks scores 0 whatever the gold value; an explicit null is a value. A key that
gold lacks makes the item a ``judge_error``; an answer that is no JSON object is a ``parsing_error``; both
score 0 throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from foliant.functions import arrays as A, dates as D, jsonx as J, text as T
from foliant.shipping import ship, spread

TOLERANCE = 1e-6
#: Metrics of each field type.
METRICS = {
    "date": ("match",),
    "number": ("match",),
    "integer": ("match",),
    "string": ("rouge1", "rouge2", "rougeL"),
    "enum": ("match", "predicted_in_choices"),
    "list": ("true_positives", "false_positives", "false_negatives", "precision", "recall", "f1"),
}
#: Metrics that stand for a field, best first.
PRIORITY = ("f1", "rougeL", "match")


def subsequence_length(x: Sequence, y: Sequence) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    places: dict = {}
    for at, token in enumerate(x):
        places[token] = places.get(token, 0) | 1 << at
    row = whole = (1 << len(x)) - 1
    for token in y:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(x) - row.bit_count()


@F.pandas_udf(IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token lists; 0 for null."""
    return pd.Series([subsequence_length(x, y) if x is not None and y is not None and len(x) and len(y) else 0 for x, y in zip(a, b)], dtype="int32")


def number_score(predicted: Column, gold: Column) -> Column:
    """1 for equal values (both null too) or numbers within the tolerance, else 0."""
    near = F.abs(predicted.try_cast("double") - gold.try_cast("double")) <= TOLERANCE
    return F.when(predicted.eqNullSafe(gold) | F.coalesce(near, F.lit(False)), 1.0).otherwise(0.0)


def enum_scores(predicted: Column, gold: Column, choices: list[str], required: bool = True) -> dict[str, Column]:
    inside = predicted.isin(*choices)
    inside = F.coalesce(inside, F.lit(not required))
    return {"match": predicted.eqNullSafe(gold).cast("double"), "predicted_in_choices": inside.cast("double")}


def _list_scores(p: Column, g: Column, hits: Column) -> dict[str, Column]:
    precision, recall, f1 = A.token_f1(hits, F.size(p), F.size(g))
    return {"true_positives": hits.cast("double"), "false_positives": (F.size(p) - hits).cast("double"), "false_negatives": (F.size(g) - hits).cast("double"), "precision": precision, "recall": recall, "f1": f1}


def list_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """Multiset counts and their ratios; null is the empty list."""
    p, g = A.or_empty(predicted), A.or_empty(gold)
    return _list_scores(p, g, A.multiset_overlap(p, g))


def _shared_runs(p: Column, g: Column) -> dict[str, Column]:
    """Common unigrams and bigrams, and the length of the longest common subsequence."""
    return {"rouge1": A.multiset_overlap(p, g), "rouge2": A.multiset_overlap(T.ngrams(p, 2), T.ngrams(g, 2)), "rougeL": common_subsequence(p, g)}


def _rouge_scores(predicted: Column, gold: Column, p: Column, g: Column, shared: Mapping[str, Column]) -> dict[str, Column]:
    out = {}
    for name, hits in shared.items():
        fewer = 1 if name == "rouge2" else 0
        value = A.token_f1(hits, F.greatest(F.size(p) - fewer, F.lit(0)), F.greatest(F.size(g) - fewer, F.lit(0)))[2]
        out[name] = F.when(predicted.eqNullSafe(gold), 1.0).when(predicted.isNull() | gold.isNull(), 0.0).otherwise(value)
    return out


def rouge_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """F-measures over unigrams, bigrams and the longest common subsequence; 1 for equal, 0 for one null."""
    p, g = T.rouge_tokens(predicted), T.rouge_tokens(gold)
    return _rouge_scores(predicted, gold, p, g, _shared_runs(p, g))


def _with_scores(rows: DataFrame, at: int, field: str, spec: Mapping) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with what a field's scores share, found once a row, and the scores over it."""
    kind, path = spec["type"], f"$.{field}"
    name = lambda what: f"_{what}{at}"
    col = lambda what: F.col(name(what))
    rows = rows.withColumns({name("p"): F.try_variant_get("_p", path, "string"), name("g"): F.try_variant_get("_g", path, "string")})
    predicted, gold = col("p"), col("g")
    if kind == "date":
        return rows, {"match": D.same_date(predicted, gold)}
    if kind in ("number", "integer"):
        return rows, {"match": number_score(predicted, gold)}
    if kind == "enum":
        return rows, enum_scores(predicted, gold, list(spec["choices"]), spec.get("required", True))
    if kind == "string":
        unlike = predicted.isNotNull() & gold.isNotNull() & (predicted != gold)  # only these pairs are compared
        rows = rows.withColumns({name("a"): F.when(unlike, T.rouge_tokens(predicted)), name("b"): F.when(unlike, T.rouge_tokens(gold))})
        rows = rows.withColumns({name(metric): hits for metric, hits in _shared_runs(col("a"), col("b")).items()})
        return rows, _rouge_scores(predicted, gold, col("a"), col("b"), {metric: col(metric) for metric in METRICS["string"]})
    if kind == "list":
        values = lambda v, s: A.or_empty(F.coalesce(F.try_variant_get(v, path, "array<string>"), F.when(s.isNotNull(), F.filter(F.split(s, ""), lambda c: c != ""))))
        rows = rows.withColumns({name("a"): values("_p", predicted), name("b"): values("_g", gold)}).withColumn(name("h"), A.multiset_overlap(col("a"), col("b")))
        return rows, _list_scores(col("a"), col("b"), col("h"))
    raise ValueError(f"unknown field type {kind!r}")


def parsed_predictions(predictions: DataFrame, schema: Mapping[str, Mapping]) -> DataFrame:
    """``idx, status, missing_keys, extra_keys`` with both records as VARIANT."""
    names = F.array(*[F.lit(f) for f in sorted(schema)])
    rows = predictions.withColumns({"_p": J.parsed_object(F.col("answer")), "_g": J.parsed_object(F.col("gold"))})
    keys = F.json_object_keys(F.to_json("_p"))
    unknown = F.lit(False)
    for field in schema:
        unknown = unknown | (J.has_key(F.col("_p"), field) & ~J.has_key(F.col("_g"), field))
    bad = F.col("_p").isNull() | F.col("_g").isNull()
    empty = F.array().cast("array<string>")
    return rows.withColumns({
        "status": F.when(bad, "parsing_error").when(unknown, "judge_error").otherwise("success"),
        "missing_keys": F.when(bad, empty).otherwise(A.sorted_difference(names, keys)),
        "extra_keys": F.when(bad, empty).otherwise(A.sorted_difference(keys, names)),
    })


def _scored(predictions: DataFrame, schema: Mapping[str, Mapping]) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """Parsed items, dealt over the cores, and their values by field and metric."""
    ship(predictions.sparkSession)
    rows, values = parsed_predictions(spread(predictions), schema), {}
    for at, (field, spec) in enumerate(schema.items()):
        good = (F.col("status") == "success") & F.coalesce(J.has_key(F.col("_p"), field), F.lit(False))
        rows, scores = _with_scores(rows, at, field, spec)
        values |= {(field, metric): F.when(good, scores[metric]).otherwise(0.0).cast("double") for metric in METRICS[spec["type"]]}
    return rows, values


def score_records(predictions: DataFrame, schema: Mapping[str, Mapping]) -> tuple[DataFrame, DataFrame]:
    """Items (``idx, status, missing_keys, extra_keys``) and scores (``idx, field, metric, value``)."""
    rows, values = _scored(predictions, schema)
    cells = [F.struct(F.lit(field).alias("field"), F.lit(metric).alias("metric"), value.alias("value")) for (field, metric), value in values.items()]
    scores = rows.select("idx", F.explode(F.array(*cells)).alias("_c")).select("idx", "_c.field", "_c.metric", "_c.value")
    return rows.select("idx", "status", "missing_keys", "extra_keys"), scores


def scored_items(predictions: DataFrame, schema: Mapping[str, Mapping], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per prediction: its status and a column for each stated field and metric. What no column needs is not
    computed, and nothing is grouped or joined."""
    rows, values = _scored(predictions, schema)
    return rows.select("idx", "status", *[values[cell].alias(name) for name, cell in columns.items()])


def mean_with_error(scores: DataFrame, by: tuple[str, ...] = ("field", "metric"), value: str = "value") -> DataFrame:
    """Mean and standard error of each group; groups of one value are left out, nulls skipped."""
    v = F.col(value)
    return scores.groupBy(*by).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("error"), F.count(v).alias("n")).where("n >= 2")


def key_frequency(items: DataFrame, column: str) -> DataFrame:
    return items.select(F.explode(column).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def item_stats(items: DataFrame) -> DataFrame:
    """Status counts and means of key lists over the items that have any, 0 without such items."""
    def mean(column: str) -> Column:
        return F.coalesce(F.bround(F.avg(F.when(F.size(column) > 0, F.size(column))), 3), F.lit(0.0))

    return items.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "parsing_error", "judge_error")],
        mean("missing_keys").alias("mean_missing_keys"), mean("extra_keys").alias("mean_extra_keys"),
    )


def best_metric(aggregated: DataFrame, field: str = "field") -> DataFrame:
    """One metric per field by priority; fields with none of them give ``unknown`` and zeros."""
    choice = F.array_min(F.collect_list(F.struct(F.coalesce(*[F.when(F.col("metric") == m, i) for i, m in enumerate(PRIORITY)], F.lit(len(PRIORITY))).alias("at"), "metric", "mean", "error")))
    best = aggregated.groupBy(field).agg(choice.alias("_b"))  # a handful of metrics per field
    known = F.col("_b.at") < len(PRIORITY)
    return best.select(field, F.when(known, F.col("_b.metric")).otherwise("unknown").alias("metric"), F.when(known, F.col("_b.mean")).otherwise(0.0).alias("mean"), F.when(known, F.col("_b.error")).otherwise(0.0).alias("error"))


def propagated_error(aggregated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over fields in percent, with the error of independent fields."""
    return aggregated.groupBy(*by).agg((F.avg("mean") * 100).alias("mean"), (F.sqrt(F.sum(F.col("error") * F.col("error"))) / F.count(F.lit(1)) * 100).alias("error"))


def run_summary(runs: DataFrame, by: tuple[str, ...], value: str = "value") -> DataFrame:
    """``m (± s)`` over runs with three decimals; one run shows nan."""
    spread = F.coalesce(F.format_string("%.3f", F.stddev_samp(value)), F.lit("nan"))
    return runs.groupBy(*by).agg(F.concat(F.format_string("%.3f", F.avg(value)), F.lit(" (± "), spread, F.lit(")")).alias("summary"))


def error_breakdown(errors: DataFrame) -> DataFrame:
    """Counts by error type, field and value."""
    return errors.select(F.inline("errors")).groupBy("error_type", "field", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_type", "field", "value")


def wide_items(items: DataFrame, scores: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """One row per item: its status and a column for each field's stated metric."""
    chosen = F.lit(False)
    for field, metric in metrics.items():
        chosen = chosen | ((F.col("field") == field) & (F.col("metric") == metric))
    table = scores.where(chosen).groupBy("idx").pivot("field", list(metrics)).agg(F.first("value"))
    return items.select("idx", "status").join(table, "idx", "left")


def run_means(aggregated: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean of the field means of each run."""
    return aggregated.groupBy(*by).agg(F.round(F.avg("mean"), digits).alias("mean"), F.count(F.lit(1)).alias("n_fields"))
