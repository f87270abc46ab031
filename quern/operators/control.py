"""Checks inside expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assert_true(condition: Column, message: str, value: Column) -> Column:
    """The value; an error if the condition is FALSE (NULL passes)."""
    return F.when(~condition, F.raise_error(F.lit(f"P0003: {message}")).cast("string")).otherwise(value.cast("string"))


def guarded(guard: Column, value: Column) -> Column:
    """The value only for rows that pass the guard; other rows never evaluate it."""
    return F.when(guard, value)
