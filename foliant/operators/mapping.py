"""Mapping of source columns to a target schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliant.functions import dates as D, jsonx as J, text as X

#: Named column functions for configured mappings.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "trim": F.trim,
    "iso_date": D.reformatted,
    "json": J.json_or_array,
    "safe_name": X.safe_name,
}


def register(name: str, transform: Callable[[Column], Column]) -> None:
    if name in TRANSFORMS:
        raise ValueError(f"transform {name} exists")
    TRANSFORMS[name] = transform


def strict(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Mapped columns alone; of sources with one target the last wins."""
    chosen = {target: source for source, target in mapping.items() if source in df.columns}
    return df.select(*[F.col(source).alias(target) for target, source in chosen.items()])


def falsy(value: Column, kind: T.DataType) -> Column:
    """Null, empty text, zero, false and empty collections."""
    out = value.isNull()
    if isinstance(kind, T.StringType):
        return out | (value == "")
    if isinstance(kind, T.NumericType):
        return out | (value == 0)
    if isinstance(kind, T.BooleanType):
        return out | ~value
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return out | (F.size(value) == 0)
    return out


def mapped(df: DataFrame, mapping: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Mapped columns, every other column under its own name unless taken, and defaults for missing or
    falsy values."""
    chosen = {target: source for source, target in mapping.items() if source in df.columns}
    for name in df.columns:
        if name not in mapping and name not in chosen:
            chosen[name] = name
    out = []
    for target, source in chosen.items():
        value = F.col(source)
        if defaults and target in defaults:
            value = F.when(falsy(value, df.schema[source].dataType), F.lit(defaults[target])).otherwise(value)
        out.append(value.alias(target))
    out += [F.lit(value).alias(name) for name, value in (defaults or {}).items() if name not in chosen]
    return df.select(*out)


def metadata_json(df: DataFrame, excluded: Sequence[str], out: str = "metadata") -> DataFrame:
    """All other columns as one JSON text."""
    names = [c for c in df.columns if c not in excluded]
    return df.withColumn(out, F.to_json(F.struct(*names)) if names else F.lit("{}"))


def first_value(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns that is not null, empty, zero or false, as text."""
    present = [F.when(~falsy(F.col(c), df.schema[c].dataType), F.col(c).cast("string")) for c in names if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first named column that exists, its nulls included."""
    return next((F.col(c) for c in names if c in df.columns), F.lit(None))


def configured(df: DataFrame, fields: Sequence[Mapping]) -> DataFrame:
    """Configured mapping: each field has ``source``, ``target`` (dots nest), and may have ``default``,
    ``transform`` and ``required``.

    A default replaces null alone; a transform that gives null keeps the value; ``rejected`` lists missing
    required targets.
    """
    flat: dict[str, Column] = {}
    missing = []
    for field in fields:
        value = F.col(field["source"]) if field["source"] in df.columns else F.lit(None).cast("string")
        if "default" in field:
            value = F.coalesce(value, F.lit(field["default"]))
        if field.get("transform"):
            value = F.coalesce(TRANSFORMS[field["transform"]](value), value)
        flat[field["target"]] = value
        if field.get("required"):
            missing.append(F.when(value.isNull(), F.lit(field["target"])))

    def nest(columns: Mapping[str, Column]) -> list[Column]:
        groups: dict[str, dict[str, Column]] = {}
        for path, value in columns.items():
            head, _, rest = path.partition(".")
            groups.setdefault(head, {})[rest] = value
        return [inner[""].alias(head) if "" in inner else F.struct(*nest(inner)).alias(head) for head, inner in groups.items()]

    return df.select(*nest(flat), F.array_compact(F.array(*missing, F.lit(None).cast("string"))).alias("rejected"))


#: Court service fields and their unified names (fixed values).
JUDGMENT_FIELDS = {
    "id": "judgment_id", "signature": "docket_number", "date": "judgment_date", "publicationDate": "publication_date", "lastUpdate": "last_update",
    "courtId": "court_id", "departmentId": "department_id", "type": "judgment_type", "excerpt": "excerpt", "content": "content", "chairman": "presiding_judge",
    "decision": "decision", "judges": "judges", "legalBases": "legal_bases", "publisher": "publisher", "recorder": "recorder", "reviser": "reviser",
    "themePhrases": "keywords", "num_pages": "num_pages", "text": "full_text", "vol_number": "volume_number", "vol_type": "volume_type",
    "court_name": "court_name", "department_name": "department_name", "text_legal_bases": "text_legal_bases", "thesis": "thesis",
}


def unified_judgment(df: DataFrame, source: str = "pl-court") -> DataFrame:
    """Court service fields under their unified names; unmapped ones are dropped."""
    return strict(df, JUDGMENT_FIELDS).withColumn("source", F.lit(source))


#: Fields of each kind of source under the names of a unified document (fixed values).
DOCUMENT_FIELDS = {
    "judgment": {"judgment_id": "document_id", "docket_number": "document_number", "judgment_date": "date_issued"},
    "tax_interpretation": {"id": "document_id"},
    "legal_act": {"id": "document_id", "title": "title", "document_number": "document_number", "enactment_date": "date_issued"},
}


def legal_document(df: DataFrame, kind: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """A source's rows as unified documents of one kind."""
    out = strict(df, names or DOCUMENT_FIELDS[kind])
    if "date_issued" in out.columns:
        out = out.withColumn("date_issued", J.as_text(F.col("date_issued"), dict(out.dtypes)["date_issued"]))
    return out.withColumn("document_type", F.lit(kind))


def serialised(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns as texts: JSON of nested values, RFC 3339 of times, empty for null."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: J.as_text(F.col(c), kinds[c]) for c in columns or df.columns})
