"""Dates: fields as exact integers and checked day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("year", "quarter", "month", "day", "hour", "minute")


def extract(field: str, x: Column) -> Column:
    """A field as an integer of scale zero."""
    if field not in FIELDS:
        raise ValueError(f"unsupported field: {field}")
    return getattr(F, {"day": "dayofmonth"}.get(field, field))(x).cast("bigint")


def add_days(d: Column, n: Column | int) -> Column:
    return F.date_add(d, n)
