"""Validation of records and configurations."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import jsonx as J
from foliant.shipping import ship

ERRORS = "array<struct<error_type:string,field:string,field_type:string,value:string>>"
_DAY = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")


def _item_errors(name: str, value, spec: Mapping) -> list[dict]:
    kind, problem = spec.get("type"), None
    if kind == "enum":
        problem = "bad_value" if value not in spec["choices"] else None
    elif kind == "date":
        problem = "bad_value" if not isinstance(value, str) else None if _DAY.fullmatch(value) else "invalid_date_format"
    elif kind == "int":
        try:
            int(value)
        except (TypeError, ValueError):
            problem = "bad_value"
    elif kind == "string":
        problem = None if isinstance(value, str) else "bad_value"
    return [{"error_type": problem, "field": name, "field_type": kind, "value": value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)}] if problem else []


def record_errors(record: Mapping, schema: Mapping[str, Mapping]) -> list[dict]:
    """Errors of a record: missing fields, bad values, unknown fields; null and empty values are valid."""
    out = []
    for name, spec in schema.items():
        if name not in record:
            out.append({"error_type": "missing", "field": name, "field_type": spec["type"], "value": None})
            continue
        value = record[name]
        if value is None or value == "":
            continue
        if spec["type"] != "list":
            out += _item_errors(name, value, spec)
        elif not isinstance(value, list):
            out += [{"error_type": "bad_value", "field": name, "field_type": "list", "value": json.dumps(value, ensure_ascii=False)}]
        elif "items" in spec:
            for item in value:
                out += _item_errors(name, item, spec["items"])
    for name, value in record.items():
        if name not in schema:
            out.append({"error_type": "unknown_field", "field": name, "field_type": None, "value": value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)})
    return out


def parse_record(text: str | None) -> dict:
    """The JSON object of a text, fenced or not; ``ValueError`` for anything else."""
    found = re.search(r"```(?:json|yaml|yml)?\s*(.*?)\s*```", text or "", re.S)
    data = json.loads(found[1] if found else text or "")
    if not isinstance(data, dict):
        raise ValueError("not an object")
    return data


def with_errors(df: DataFrame, column: str, schema: Mapping[str, Mapping]) -> DataFrame:
    """``errors`` and ``num_errors`` of the JSON or YAML records in a column; unparsable ones have one error."""
    ship(df.sparkSession)
    schema = dict(schema)
    record = F.coalesce(F.to_json(J.yaml_object(F.col(column))), F.col(column))

    def one(text):
        try:
            return record_errors(parse_record(text), schema)
        except ValueError as problem:
            return [{"error_type": "parsing_error", "field": None, "field_type": None, "value": str(problem)}]

    @F.pandas_udf(ERRORS)
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return df.withColumn("errors", run(record)).withColumn("num_errors", F.size("errors"))


def valid_records(df: DataFrame, column: str, schema: Mapping[str, Mapping]) -> DataFrame:
    """Rows whose record has no error."""
    return with_errors(df, column, schema).where("num_errors = 0").drop("errors", "num_errors")


def errors_per_split(validated: DataFrame, split: str = "split") -> DataFrame:
    return validated.groupBy(split).agg(F.sum("num_errors").alias("num_errors"))


def schema_from_text(spec: str) -> dict[str, dict]:
    """An extraction schema from lines ``name: type - description``.

    Types are a word, ``enum [a, b]`` or ``list of enum [a, b]``; true and false among choices are booleans.
    """
    schema: dict[str, dict] = {}
    for line in filter(None, (x.strip() for x in spec.splitlines())):
        found = re.fullmatch(r"(\w+)\s*:\s*((?:list of )?\w+)\s*(\[[^\]]*\])?\s*(?:-\s*(.*?))?(?:\s*\(example:\s*(.*)\))?", line)
        if not found:
            raise ValueError(f"not a field: {line!r}")
        name, kind, choices, description, example = found.groups()
        values = [{"true": True, "false": False}.get(c.strip().lower(), c.strip()) for c in choices[1:-1].split(",")] if choices else None
        if kind.startswith("list of "):
            schema[name] = {"type": "list", "items": {"type": kind[8:]} | ({"choices": values} if values else {})}
        else:
            schema[name] = {"type": kind} | ({"choices": values} if values else {})
        schema[name] |= {k: v for k, v in (("description", description), ("example", example)) if v}
    return schema


def schema_lines(schema: Mapping[str, object]) -> str:
    return "\n".join(f"{name}: {value}" for name, value in schema.items())


def violations(checks: Mapping[str, Column]) -> Column:
    """Names of the failed checks of a row; an undecided check has failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def document_violations(language: str = "language", status: str = "processing_status", kind: str = "document_type", statuses: Sequence[str] = ("pending", "processing", "completed", "failed"), kinds: Sequence[str] = ("judgment", "tax_interpretation", "legal_act")) -> Column:
    """Constraints of a unified document; null values pass."""
    passes = lambda c, ok: F.col(c).isNull() | ok
    return violations({language: passes(language, F.length(language).isin(2, 5)), status: passes(status, F.lower(status).isin(*statuses)), kind: passes(kind, F.col(kind).isin(*kinds))})


def text_warnings(text: str, short: int = 10, long: int = 100_000) -> Column:
    length = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return F.array_compact(F.array(F.when(length < short, "very_short"), F.when(length > long, "very_long")))


def column_kinds(df: DataFrame) -> dict[str, str]:
    """What each column holds: text, number, truth, time, list or record."""
    def kind(name: str) -> str:
        if name.startswith(("array",)):
            return "list"
        if name.startswith(("struct", "map", "variant")):
            return "record"
        if name.startswith(("timestamp", "date")):
            return "time"
        return {"string": "text", "boolean": "truth"}.get(name, "number" if name.startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")) else name)

    return {c: kind(t) for c, t in df.dtypes}


def kind_flags(df: DataFrame, wanted: Mapping[str, str]) -> dict[str, bool]:
    """Whether each wanted column exists and holds the wanted kind."""
    kinds = column_kinds(df)
    return {c: kinds.get(c) == k for c, k in wanted.items()}


def no_list(column: str) -> Column:
    """Whether a text that should be a JSON list is something else; null passes."""
    return F.col(column).isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(column))).startswith("ARRAY"), F.lit(False))


def rule_report(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """``rule, level, n_failed, blocks`` in one pass over (name, level, passes) rules; failed critical ones block."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, _, ok in rules])
    levels = F.create_map(*[F.lit(x) for name, level, _ in rules for x in (name, level)])
    report = counts.unpivot([], [name for name, _, _ in rules], "rule", "n_failed").withColumn("level", levels[F.col("rule")])
    return report.withColumn("blocks", (F.col("level") == "CRITICAL") & (F.col("n_failed") > 0))


def success_rate(processed: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(processed, total), F.lit(0.0))


def confidence_level(score: float) -> str:
    return "high" if score >= 0.8 else "medium" if score >= 0.5 else "low"


def mapping_problems(mapping: Mapping[str, str], targets: Sequence[str], required: Sequence[str] = (), models: Sequence[str] = (), sources: Sequence[str] = ()) -> dict[str, list[str]]:
    """Unknown targets, required targets without a source, models named twice, sources that nothing maps."""
    return {
        "unknown_targets": sorted({t for t in mapping.values() if t not in targets}),
        "missing_required": sorted(set(required) - set(mapping.values())),
        "duplicate_models": sorted({m for m in models if list(models).count(m) > 1}),
        "unmapped_sources": sorted(set(sources) - set(mapping)),
    }


@dataclass(frozen=True)
class IngestSettings:
    """Checked settings of an ingestion."""

    chunk_size: int = 512
    overlap: int = 128
    least_chars: int = 0
    vectors: tuple[str, ...] = ("base", "dev", "fast")
    log_level: str = "INFO"

    def __post_init__(self):
        if self.overlap >= self.chunk_size:
            raise ValueError("the overlap must be smaller than the chunk size")
        if not {"base", "dev", "fast"} <= set(self.vectors):
            raise ValueError("vectors base, dev and fast are required")
        if self.log_level not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError(f"unknown log level {self.log_level!r}")
