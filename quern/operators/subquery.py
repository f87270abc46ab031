"""Subqueries: three-valued IN as a value, single-row scalars, key filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_set(df: DataFrame, x: Column, values: DataFrame, name: str, negated: bool = False) -> DataFrame:
    """Add ``x IN (values)`` as a three-valued column.

    ``values`` has one column. TRUE if x is among them; NULL if x is null and
    the set is not empty, or if x is not found and the set has a null; else
    FALSE. The set meets the rows in one join on its distinct members; how
    many there are and whether one is null is a single row, which is broadcast.
    """
    column = values.columns[0]
    member = values.select(F.col(column).alias("__member")).where(F.col("__member").isNotNull()).distinct()
    facts = values.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.max(F.col(column).isNull()), F.lit(False)).alias("__null"))
    joined = df.withColumn("__x", x).join(member, F.col("__x") == F.col("__member"), "left").crossJoin(F.broadcast(facts))
    value = (
        F.when(F.col("__n") == 0, F.lit(False)).when(F.col("__x").isNull(), F.lit(None).cast("boolean")).when(F.col("__member").isNotNull(), F.lit(True)).when(F.col("__null"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    )
    return joined.withColumn(name, ~value if negated else value).drop("__x", "__member", "__n", "__null")


def scalar_of(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Add the value of a one-column subquery: null for no row, an error for more than one."""
    column = values.columns[0]
    few = values.limit(2).agg(F.count(F.lit(1)).alias("__n"), F.first(column).alias("__v"))
    value = F.when(F.col("__n") > 1, F.raise_error(F.lit("21000: more than one row returned by a subquery used as an expression")).cast(dict(values.dtypes)[column])).otherwise(F.col("__v"))
    return df.crossJoin(F.broadcast(few)).withColumn(name, value).drop("__n", "__v")


def key_filter(inner: DataFrame, keys: list[str], outer: DataFrame) -> DataFrame:
    """Keep the rows of a correlated subquery's input whose keys the outer query asks for, before they are aggregated."""
    return inner.join(outer.select(*keys).distinct(), keys, "left_semi")


def with_correlated(outer: DataFrame, keys: list[str], aggregates: dict[str, Column], inner: DataFrame | None = None) -> DataFrame:
    """Add the aggregates of a correlated subquery over ``inner`` rows with equal keys.

    The key filter always stands below the aggregate. Where the subquery reads
    the outer query's own rows (``inner`` is None: every row of the keys is
    there), a window gives the aggregates in the same pass; each is then a plain
    aggregate, without arithmetic around it.
    """
    if inner is None:
        over = Window.partitionBy(*keys)
        return outer.select("*", *[a.over(over).alias(n) for n, a in aggregates.items()])
    return outer.join(key_filter(inner, keys, outer).groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]), keys, "left")


def null_aware_anti(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``key NOT IN (values)`` as a filter, without needing the set in one place.

    Nothing passes if the set has a null; a null key passes only if the set is
    empty.
    """
    column = values.columns[0]
    facts = values.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.max(F.col(column).isNull()), F.lit(False)).alias("__null"))
    kept = df.join(values.select(F.col(column).alias("__member")).where("__member IS NOT NULL").distinct(), F.col(key) == F.col("__member"), "left_anti")
    return kept.crossJoin(F.broadcast(facts)).where(~F.col("__null") & ((F.col("__n") == 0) | F.col(key).isNotNull())).drop("__n", "__null")
