"""JSON in text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unfenced(text: Column) -> Column:
    """What stands inside the first fence of a markdown answer, else the text; trimmed."""
    inner = F.regexp_extract(text, r"(?s)```(?:json|yaml|yml)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def parsed_object(text: Column) -> Column:
    """VARIANT of a JSON object, null for anything else."""
    inner = unfenced(text)
    return F.when(inner.startswith("{"), F.try_parse_json(inner))


def keys_of(text: Column) -> Column:
    """Sorted keys of the JSON object in a text; null where there is none."""
    return F.array_sort(F.json_object_keys(F.to_json(parsed_object(text))))


def has_key(variant: Column, key: str) -> Column:
    """Whether an object has a key, a null value included."""
    return F.try_variant_get(variant, f"$.{key}", "variant").isNotNull()


def yaml_object(text: Column) -> Column:
    """VARIANT of the flat mapping in a fenced or bare YAML answer, null for anything else.

    Lines are ``key: value``; a value is a number, true, false, null, a quoted or plain text, a list in
    brackets, or nothing, in which case following lines ``- item`` are its list. Comments and blank lines
    are skipped. JSON objects are YAML too.
    """
    inner = unfenced(text)
    lines = F.filter(F.transform(F.split(inner, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"(^|\s)#.*$", ""))), lambda x: (x != "") & (x != "---"))
    key, item = r"^([A-Za-z_][\w -]*?)\s*:(?:\s+(.*))?$", r"^\s*-\s+(.*)$"
    quoted = lambda v: F.to_json(F.array(v))

    def plain(v: Column) -> Column:
        one = F.when(v.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), v).when(F.lower(v).isin("true", "false"), F.lower(v)).when(F.lower(v).isin("null", "~", ""), F.lit("null"))
        bare = F.when(v.rlike(r"^'.*'$|^\".*\"$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.coalesce(one, F.regexp_extract(quoted(bare), r"(?s)^\[(.*)\]$", 1))

    def value(v: Column) -> Column:
        items = F.transform(F.split(F.regexp_extract(v, r"^\[(.*)\]$", 1), r",\s*"), lambda x: plain(F.trim(x)))
        return F.when(v.rlike(r"^\[\s*\]$"), F.lit("[]")).when(v.rlike(r"^\[.*\]$"), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(plain(v))

    def step(state: Column, line: Column) -> Column:
        name, said, listed = F.regexp_extract(line, key, 1), F.trim(F.regexp_extract(line, key, 2)), F.regexp_extract(line, item, 1)
        pair = F.struct(name.alias("k"), F.when(said != "", F.array(value(said))).otherwise(F.array().cast("array<string>")).alias("v"), (said == "").alias("open"))
        last = F.element_at(state["pairs"], -1)
        more = F.struct(last["k"].alias("k"), F.concat(last["v"], F.array(plain(F.trim(listed)))).alias("v"), F.lit(True).alias("open"))
        can = line.rlike(item) & (F.size(state["pairs"]) > 0) & F.coalesce(F.try_element_at(state["pairs"], F.lit(-1))["open"], F.lit(False))
        added = F.when(line.rlike(key), F.concat(state["pairs"], F.array(pair))).when(can, F.concat(F.slice(state["pairs"], 1, F.greatest(F.size(state["pairs"]) - 1, F.lit(0))), F.array(more))).otherwise(state["pairs"])
        return F.struct(added.alias("pairs"), (state["good"] & (line.rlike(key) | can)).alias("good"))

    kind = "struct<pairs:array<struct<k:string,v:array<string>,open:boolean>>,good:boolean>"
    read = F.aggregate(lines, F.struct(F.array().alias("pairs"), F.lit(True).alias("good")).cast(kind), lambda s, x: step(s, x).cast(kind))
    shown = lambda p: F.when(~p["open"], p["v"][0]).when(F.size(p["v"]) == 0, F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(p["v"], ","), F.lit("]")))
    body = F.array_join(F.transform(read["pairs"], lambda p: F.concat(F.regexp_extract(quoted(p["k"]), r"(?s)^\[(.*)\]$", 1), F.lit(":"), shown(p))), ",")
    block = F.when(read["good"] & (F.size(read["pairs"]) > 0), F.try_parse_json(F.concat(F.lit("{"), body, F.lit("}"))))
    return F.when(inner.startswith("{"), F.try_parse_json(inner)).otherwise(block)


def as_text(value: Column, kind: str) -> Column:
    """One text form of any value: JSON of nested ones, RFC 3339 of times, empty for null."""
    if kind.startswith(("array", "struct", "map")):
        out = F.to_json(value)
    elif kind.startswith("timestamp"):
        out = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit(""))


def json_or_array(text: Column) -> Column:
    """A text that is JSON stays; any other becomes an array of one string."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.array(text)))


def has_any_value(text: Column) -> Column:
    """Whether a JSON object has a value that is not null."""
    values = F.map_values(F.from_json(text, "map<string,string>"))
    return F.coalesce(F.exists(values, lambda v: v.isNotNull()), F.lit(False))


def null_if_all_falsy(record: Column, fields: list[str]) -> Column:
    """The struct, or null if all its text fields are null or empty."""
    some = F.lit(False)
    for name in fields:
        some = some | F.coalesce(record[name].cast("string") != "", F.lit(False))
    return F.when(some, record)


def unwrapped(text: Column, key: str) -> Column:
    """A list from ``{key: value}`` or ``{key: [values]}`` in JSON text; null stays null, several keys raise."""
    keys = F.json_object_keys(text)
    listed = F.from_json(F.get_json_object(text, f"$.{key}"), "array<string>")
    one = F.get_json_object(text, f"$.{key}")
    value = F.when(one.startswith("["), listed).when(one.isNotNull(), F.array(one))
    return F.when(F.size(keys) > 1, F.raise_error(F.lit("more than one key")).cast("array<string>")).otherwise(value)
