"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_key(key: Column, width: int = 10) -> Column:
    """An integer key with leading zeros."""
    return F.lpad(key.cast("bigint").cast("string"), width, "0")


def accession(number: Column) -> Column:
    """18 digits as 10-2-6; anything else unchanged."""
    dashed = F.concat_ws("-", F.substring(number, 1, 10), F.substring(number, 11, 2), F.substring(number, 13, 6))
    return F.when(F.length(number) == 18, dashed).otherwise(number)


def stripped(text: Column) -> Column:
    """Without Unicode space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Tokens between runs of Unicode space; a null text has none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    return F.size(parts).cast("long")


def or_else(text: Column, default: Column) -> Column:
    """The default for null or empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), default)


def short_digest(text: Column) -> Column:
    """First sixteen hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)
