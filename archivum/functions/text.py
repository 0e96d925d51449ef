"""Scalar text normalisation as Column expressions, so that it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it (Java's \s is ASCII only).
SPACE = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def squeeze(c: Column) -> Column:
    """Outer white space dropped, inner runs as one blank; null stays null."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def strip(c: Column) -> Column:
    """Outer white space dropped."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def fold(c: Column) -> Column:
    """Case ignored, white space squeezed, null as the empty string."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def header_key(c: Column) -> Column:
    """A header without case and without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_missing(c: Column, tokens: list[str]) -> Column:
    """Null, blank, or a placeholder (case and outer space ignored)."""
    value = F.lower(strip(c))
    found = c.isNull() | (value == "")
    return (found | value.isin([t.strip().lower() for t in tokens])) if tokens else found
