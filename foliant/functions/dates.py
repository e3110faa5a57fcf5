"""Column functions over dates in text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ZONE = "Europe/Warsaw"
#: Tried in order; text is cut at fractions and zone names before.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy", "dd-MM-yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "d MMMM yyyy HH:mm:ss", "d MMMM yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "MMM d HH:mm:ss yyyy",
)


_SHAPES = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}


def _shape(form: str) -> str:
    """A regular expression of the texts that a format can read."""
    found = re.findall(r"'([^']*)'|(y+|M+|d+|H+|m+|s+)|(.)", form)
    return "^" + "".join(_SHAPES[letters] if letters else re.escape(quoted or sign) for quoted, letters, sign in found) + "$"


def parsed(text: Column, formats: Sequence[str] = FORMATS) -> Column:
    """Wall-clock timestamp of the first format that fits, or null; a leading weekday is skipped.

    A format is tried only on texts of its shape, as failed attempts are slow.
    """
    text = F.regexp_replace(text, r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    return F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]).cast("timestamp_ntz")


def rfc3339(text: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """RFC 3339 text and an error message; empty and null give null without an error.

    A wall-clock time is in ``zone``, as are times that name CET or CEST; the offset follows that zone's
    summer time. A time that names UTC, GMT, Z or an offset keeps it.
    """
    trimmed = F.trim(text)
    named = F.regexp_extract(trimmed, r"(?:\d|\s)(Z|UTC|GMT|[+-]\d\d:?\d\d)$", 1)
    bare = F.trim(F.regexp_replace(trimmed, r"(\.\d+)?\s*(CET|CEST|Z|UTC|GMT|(?<=:\d\d)\s*[+-]\d\d:?\d\d)?$", ""))
    local = parsed(bare)
    instant = F.to_utc_timestamp(local.cast("timestamp"), zone)
    minutes = ((F.unix_timestamp(local.cast("timestamp")) - F.unix_timestamp(instant)) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.abs(F.floor(F.abs(minutes) / 60)).cast("int"), (F.abs(minutes) % 60).cast("int"))
    told = F.when(named.isin("Z", "UTC", "GMT"), "+00:00").when(named != "", F.regexp_replace(named, r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
    empty = text.isNull() | (trimmed == "")
    out = F.when(~empty & local.isNotNull(), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(told, offset)))
    return out, F.when(~empty & local.isNull(), F.concat(F.lit("Failed to convert date: "), text))


def with_rfc3339(df: DataFrame, columns: Sequence[str], zone: str = ZONE) -> DataFrame:
    """Those of the named columns that exist as RFC 3339 texts; ``date_errors`` lists what failed."""
    names = [c for c in columns if c in df.columns]
    if not names:
        return df.withColumn("date_errors", F.array().cast("array<string>"))
    both = {c: rfc3339(F.col(c), zone) for c in names}
    errors = F.array_compact(F.array(*[both[c][1] for c in names]))
    return df.withColumns({"date_errors": errors} | {c: both[c][0] for c in names})


def local_midnight(day: Column, zone: str = ZONE) -> Column:
    """The instant at which a day without a time begins in ``zone``."""
    return F.to_utc_timestamp(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), zone)


def reformatted(text: Column, formats: Sequence[str] = FORMATS) -> Column:
    """As ``yyyy-MM-dd``, or unchanged where no format fits."""
    return F.coalesce(F.date_format(parsed(text, formats), "yyyy-MM-dd"), text)


def or_fallback(text: Column, fallback: str = "2023-01-01T00:00:00Z") -> Column:
    """ISO text with ``Z`` from one of three formats, else a constant."""
    found = parsed(F.trim(text), ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy"))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(fallback))


def days_between(first: Column, last: Column) -> Column:
    """All days from ``first`` to ``last``, both included."""
    return F.sequence(first, last, F.expr("interval 1 day"))


def same_date(a: Column, b: Column) -> Column:
    """1 when equal (both null too) or when both name one date, else 0."""
    both = parsed(a).cast("date") == parsed(b).cast("date")
    return F.when(a.eqNullSafe(b) | F.coalesce(both, F.lit(False)), 1.0).otherwise(0.0)


def end_of_window(days: int = 14, zone: str = ZONE) -> Column:
    """Today's date in ``zone``, some days back."""
    return F.date_sub(F.to_date(F.from_utc_timestamp(F.current_timestamp(), zone)), days)


def leading_date(text: Column, day_first: bool = True) -> Column:
    """The date before the first space, in one of several forms, or null."""
    mixed = ("dd/MM/yyyy", "dd-MM-yyyy") if day_first else ("MM/dd/yyyy", "MM-dd-yyyy")
    return parsed(F.split_part(F.trim(text), F.lit(" "), F.lit(1)), ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", *mixed)).cast("date")
