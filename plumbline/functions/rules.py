"""Ordered rules as one Catalyst expression: the first that holds decides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Iterable[tuple[Column, object]], default: object) -> Column:
    """rules: (condition, value) in order."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def has(text: Column, *parts: str) -> Column:
    """Any of the parts stands in the text."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def filled(value: Column) -> Column:
    """Null where the text is empty: the older code treats both alike."""
    return F.nullif(value, F.lit(""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
