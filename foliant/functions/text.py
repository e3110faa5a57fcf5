"""Column functions over text; built-in expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Tokens between white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def worded_tokens(text: Column) -> Column:
    """Tokens with at least one character that is no ASCII punctuation."""
    return F.filter(tokens(text), lambda t: t.rlike(r"[^\p{Punct}]"))


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by a space."""
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def collapse_newlines(text: Column) -> Column:
    """Runs of blank lines become one, and the ends are stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"(\n\s*)+\n+", "\n\n"), r"^\s+|\s+$", "")


def first_part(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def shortened(text: Column, n: int = 100) -> Column:
    """Texts of more than ``n`` characters end in three dots."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def contains_any_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def highlighted(text: Column, terms: Sequence[str], opening: str = "<span class='highlight'>", closing: str = "</span>") -> Column:
    """Every occurrence of a term, in any case, wrapped in markup; longer terms first."""
    import re

    if not terms:
        return text
    pattern = "(?i)(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"
    return F.regexp_replace(text, pattern, f"{opening}$1{closing}")


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` fields filled in and the ends stripped; null values are empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def safe_name(text: Column) -> Column:
    """Slashes of both kinds become underscores."""
    return F.translate(text, "/\\", "__")


def first_words(text: Column, n: int = 3) -> Column:
    """The first ``n`` words, single-spaced."""
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def is_url(text: Column) -> Column:
    """Whether a URL has a scheme and a host."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def near_term(text: Column, term: str, edits: int = 1) -> Column:
    """Whether a token is within ``edits`` edits of ``term``."""
    return F.exists(tokens(F.lower(text)), lambda t: F.levenshtein(t, F.lit(term.lower()), edits) >= 0)


def regex_rewritten(text: Column, rules: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """The first rule whose pattern occurs rewrites the text; else ``default`` or the text."""
    out = text if default is None else default
    for pattern, replacement in reversed(rules):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, replacement)).otherwise(out)
    return out


def mapped(text: Column, table: Mapping[str, str], default: Column | None = None, any_case: bool = False) -> Column:
    """A value looked up in a table, else ``default`` or the value itself."""
    pairs = F.create_map(*[F.lit(x.lower() if any_case and i == 0 else x) for pair in table.items() for i, x in enumerate(pair)])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(text)) if any_case else text), text if default is None else default)


def role_of(text: Column) -> Column:
    """What stands between two slashes, or null."""
    found = F.regexp_extract(text, "/([^/]*)/", 1)
    return F.when(found != "", F.trim(found))


def without_role(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "/[^/]*/", ""))


def truncated_to_tokens(text: Column, budget: Column) -> tuple[Column, Column, Column]:
    """First ``budget`` tokens, how many were cut, and their share; no budget gives an empty text and nulls."""
    words = tokens(text)
    cut = F.greatest(F.size(words) - budget, F.lit(0))
    has = budget > 0
    kept = F.when(has, F.array_join(F.slice(words, F.lit(1), F.greatest(budget, F.lit(1))), " ")).otherwise("")
    return kept, F.when(has, cut), F.when(has, F.coalesce(F.try_divide(cut, F.size(words)), F.lit(0.0)))
