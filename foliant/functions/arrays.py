"""Column functions over arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def or_empty(values: Column, kind: str = "array<string>") -> Column:
    """The array, or an empty one for null."""
    return F.coalesce(values, F.array().cast(kind))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection; null arrays count as empty, nulls inside as a value."""
    count = lambda values, x: F.size(F.filter(values, lambda y: y.eqNullSafe(x)))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda total, x: total + F.least(count(a, x), count(b, x)))


def sorted_difference(a: Column, b: Column) -> Column:
    """Sorted distinct values of ``a`` that ``b`` lacks."""
    return F.array_sort(F.array_except(a, b))


def strings_of(value: Column, is_list: bool) -> Column:
    """A list of strings from a list or a single value; null, blank and empty give an empty list."""
    if is_list:
        return or_empty(F.transform(value, lambda x: x.cast("string")))
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.array(text))


def split_list(value: Column) -> Column:
    """Items of a text separated by commas or semicolons, trimmed, blanks dropped; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def without_placeholders(values: Column, placeholders: Sequence[str] = ("don't know", "data not available")) -> Column:
    """Values of a list that are no placeholders (trimmed, any case); null when none is left."""
    kept = F.filter(values, lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin(*placeholders))
    return F.when(F.size(kept) > 0, kept)


def looked_up(values: Column, table: Mapping[str, str | None]) -> Column:
    """Values replaced through a table; those mapped to null are dropped, null when none is left."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    kept = F.filter(F.transform(values, lambda x: F.try_element_at(pairs, x)), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def unknown_values(values: Column, known: Sequence[str]) -> Column:
    """Values outside a vocabulary."""
    return F.filter(values, lambda x: ~x.isin(*known))


def all_whole_numbers(values: Column) -> Column:
    """Whether every value reads as an integer; null counts as valid."""
    return F.coalesce(F.forall(values, lambda x: F.coalesce(x.try_cast("int").isNotNull(), F.lit(False))), F.lit(True))


def any_contains(values: Column, part: str) -> Column:
    """Whether a value contains ``part``."""
    return F.exists(values, lambda x: F.contains(x, F.lit(part)))


def token_f1(overlap: Column, n_predicted: Column, n_gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(overlap, n_predicted), zero)
    recall = F.coalesce(F.try_divide(overlap, n_gold), zero)
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)


def contains_value(values: Column, value: Column) -> Column:
    """Whether a list holds a value; null lists and values give false."""
    return F.coalesce(F.array_contains(or_empty(values), value), F.lit(False))


def any_of(values: Column, wanted: Sequence[str], part: bool = False) -> Column:
    """Whether a list holds one of the wanted values, or a value that contains one of them."""
    def holds(want: str) -> Column:
        return F.exists(or_empty(values), lambda x: F.coalesce(F.contains(x, F.lit(want)) if part else x == want, F.lit(False)))

    hit = F.lit(False)
    for want in wanted:
        hit = hit | holds(want)
    return hit


def set_counts(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Common values, those of the prediction alone and those of gold alone, as sets; null lists are empty."""
    p, g = F.array_distinct(or_empty(predicted)), F.array_distinct(or_empty(gold))
    return F.size(F.array_intersect(p, g)), F.size(F.array_except(p, g)), F.size(F.array_except(g, p))


def flat_without_placeholders(values: Column, placeholders: Sequence[str] = ("don't know", "data not available")) -> Column:
    """One level of nesting removed, then as ``without_placeholders``."""
    return without_placeholders(F.flatten(F.transform(values, lambda x: or_empty(x))), placeholders)


def first_parts(values: Column) -> Column:
    """The part before the first white space of each item."""
    return F.transform(values, lambda x: F.regexp_extract(F.ltrim(x), r"^\S*", 0))


def whole_numbers(values: Column) -> Column:
    """Items as integers; others are null."""
    return F.transform(values, lambda x: F.trim(x).try_cast("int"))


def canonical(text: Column, table: Mapping[str, str]) -> tuple[Column, Column]:
    """A category's canonical name (trimmed, any case) and, where there is none, the unknown value."""
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.strip().lower(), v)])
    known = F.try_element_at(pairs, F.lower(F.trim(text)))
    return known, F.when(text.isNotNull() & known.isNull(), text)
