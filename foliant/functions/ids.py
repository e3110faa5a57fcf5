"""Deterministic identifiers."""

from __future__ import annotations

from uuid import NAMESPACE_DNS, UUID

from pyspark.sql import Column, functions as F


def _dashed(digits: Column) -> Column:
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def sha_uuid(doc_id: Column, chunk_id: Column | None = None) -> Column:
    """The first 32 digits of a SHA-256 in UUID form; a missing chunk, or chunk 0, gives the document's."""
    key = doc_id.cast("string")
    if chunk_id is not None:
        key = F.when(chunk_id.isNull() | (chunk_id == 0), key).otherwise(F.concat(key, F.lit("_"), chunk_id.cast("string")))
    return _dashed(F.sha2(key, 256))


def name_uuid(name: Column, namespace: UUID = NAMESPACE_DNS) -> Column:
    """Version 5 UUID of a name, from its SHA-1."""
    digits = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return _dashed(F.concat(F.substring(digits, 1, 12), F.lit("5"), F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15)))
