"""Exact numbers: checked division, sums, averages, deviations and casts.

Spark's defaults differ from the semantics kept here in a few places: ``/`` on
integers is double, ``sum(bigint)`` overflows, ``avg`` of integers is double,
casts to integers truncate, and float overflow gives infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = "decimal(38,0)"


def div_int(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Integer quotient that truncates towards zero; a zero divisor is an error."""
    return F.call_function("div", a, b).cast(kind)


def mod_int(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign."""
    return a % b


def sum_exact(x: Column) -> Column:
    """Sum of integers that never overflows below 38 digits."""
    return F.sum(x.cast(BIG)).cast(BIG)


def _quotient(units: Column, parts: Column, scale: int) -> Column:
    """units / parts of integers of up to 38 digits, half away from zero: whole part and fraction divided apart, so that no digit is lost."""
    parts = F.nullif(parts.cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    whole = F.call_function("div", units, parts).cast(BIG)
    rest = (units - (whole * parts).cast(BIG)).cast("decimal(19,0)")
    unit = F.lit("1" + "0" * scale).cast(f"decimal({scale + 1},0)")
    scaled = (rest * unit).cast(BIG)
    fraction = F.call_function("div", scaled, parts).cast(BIG)
    left = (scaled - (fraction * parts).cast(BIG)).cast("decimal(20,0)")
    away = F.when(F.abs(left) * 2 >= F.abs(parts), F.signum(left) * F.signum(parts)).otherwise(F.lit(0)).cast(BIG)
    behind = (fraction + away).cast(f"decimal({scale + 1},0)") * F.lit("0." + "0" * (scale - 1) + "1").cast(f"decimal({scale},{scale})")
    return (whole.cast(f"decimal({37 - scale},0)") + behind.cast(f"decimal({scale + 1},{scale})")).cast(f"decimal(38,{scale})")


def avg_exact(x: Column, scale: int = 16, decimals: int = 6) -> Column:
    """Average of integers or of decimals with at most ``decimals`` digits behind the point, exact to ``scale`` digits.

    The sum in units of the last digit is divided as an integer; a sum has up to
    38 digits, the count up to 19 less ``decimals``.
    """
    unit = F.lit("1" + "0" * decimals).cast(f"decimal({decimals + 1},0)")
    total = F.sum((x.cast(f"decimal(28,{decimals})") * unit).cast("decimal(28,0)")).cast(BIG)
    return _quotient(total, F.count(x) * F.lit(10**decimals), scale)


def avg_merge(partial_sum: Column, partial_count: Column) -> Column:
    """Average from partial states; null when no row was counted."""
    return F.sum(partial_sum) / F.nullif(F.sum(partial_count), F.lit(0))


def count_merge(partial_count: Column) -> Column:
    return F.coalesce(F.sum(partial_count), F.lit(0)).cast("bigint")


def variance_exact(x: Column, sample: bool = True) -> Column:
    """Variance of integers from exact sums; null below one (or two, for a sample) values."""
    v = x.cast("decimal(19,0)")
    n, s, q = F.count(x).cast("decimal(19,0)"), F.sum(v).cast("decimal(38,0)"), F.sum((v * v).cast("decimal(28,0)")).cast("decimal(38,0)")
    numerator = F.greatest(n * q - s * s, F.lit(0).cast(BIG)).cast("double")
    below = n * (n - 1) if sample else n * n
    return F.when(F.count(x) > (1 if sample else 0), numerator / below.cast("double"))


def variance_decimal(x: Column, sample: bool = True, scale: int = 16) -> Column:
    """Variance of integers as a decimal, every digit right; null below one (or two, for a sample) values."""
    v = x.cast("decimal(10,0)")
    n, s, q = F.count(x).cast("decimal(18,0)"), F.sum(v).cast("decimal(19,0)"), F.sum((v * v).cast("decimal(20,0)")).cast("decimal(20,0)")
    numerator = ((n * q).cast(BIG) - (s * s).cast(BIG)).cast(BIG)
    below = (n.cast("decimal(9,0)") * (n - 1 if sample else n).cast("decimal(9,0)")).cast("decimal(19,0)")
    return F.when(F.count(x) > (1 if sample else 0), _quotient(numerator, below, scale))


def avg_over(x: Column, window, scale: int = 16, decimals: int = 2) -> Column:
    """Average over a window's frame, exact to ``scale`` digits, of decimals with at most ``decimals`` digits behind the point."""
    unit = F.lit("1" + "0" * decimals).cast(f"decimal({decimals + 1},0)")
    total = F.sum((x.cast(f"decimal(28,{decimals})") * unit).cast("decimal(28,0)")).over(window).cast(BIG)
    return _quotient(total, F.count(x).over(window) * F.lit(10**decimals), scale)


def stddev_exact(x: Column, sample: bool = True) -> Column:
    return F.sqrt(variance_exact(x, sample))


def float_checked(value: Column, *inputs: Column) -> Column:
    """An error where finite inputs gave an infinite float."""
    finite = F.lit(True)
    for x in inputs:
        finite = finite & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite & (F.abs(value) == F.lit(float("inf"))), F.raise_error(F.lit("22003: value out of range: overflow")).cast("double")).otherwise(value)


def sum_float(x: Column) -> Column:
    """Sum of floats; an error where finite values gave an infinite sum."""
    total, infinite = F.sum(x), F.bool_or(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    lost = (F.abs(total) == F.lit(float("inf"))) & ~F.coalesce(infinite, F.lit(False))
    return F.when(lost, F.raise_error(F.lit("22003: value out of range: overflow")).cast("double")).otherwise(total)


def divide_decimal(a: Column, b: Column, scale: int = 16, decimals: int = 4) -> Column:
    """Quotient of decimals at a fixed scale, half away from zero; a zero divisor is an error.

    Both sides are made integers in units of ``10 ** -decimals``, which must hold
    all their digits: the dividend up to 38 of them, the divisor up to 19.
    """
    unit = F.lit("1" + "0" * decimals).cast(f"decimal({decimals + 1},0)")
    checked = F.when(b == 0, F.raise_error(F.lit("22012: division by zero")).cast("decimal(19,0)")).otherwise((b * unit).cast("decimal(19,0)"))
    return _quotient((a * unit).cast(BIG), checked, scale)


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def float_to_int(x: Column, kind: str = "int") -> Column:
    """Round half to even, then check the range."""
    return F.rint(x).cast(kind)


def decimal_to_int(x: Column, kind: str = "int") -> Column:
    """Round half away from zero, then check the range."""
    return F.round(x, 0).cast(kind)


def double_to_float(x: Column) -> Column:
    """Narrow to single precision; a finite value that does not fit is an error."""
    narrow = x.cast("float")
    lost = (F.abs(narrow.cast("double")) == F.lit(float("inf"))) & (F.abs(x) < F.lit(float("inf")))
    return F.when(lost, F.raise_error(F.lit("22003: value out of range: overflow")).cast("float")).otherwise(narrow)


def ratio_compare(a: Column, b: Column, c: Column) -> Column:
    """Sign of a / b - c without dividing, for decimals; null if any is null."""
    left, right = a, c * b
    return F.when(b == 0, F.raise_error(F.lit("22012: division by zero")).cast("int")).otherwise(F.signum(F.when(b > 0, left - right).otherwise(right - left)).cast("int"))
