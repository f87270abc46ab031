"""Sort keys with nulls last for ascending and first for descending order, always spelt out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import settle


def asc(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def top_k(df: DataFrame, keys: list[Column], k: int, offset: int = 0) -> DataFrame:
    """Sort and limit in one step: every task keeps its own first rows only."""
    out = df.orderBy(*keys)
    return (out.offset(offset) if offset else out).limit(k)


def top_k_late(df: DataFrame, keys: list[str], k: int, row_key: list[str], ascending: bool = True) -> DataFrame:
    """Top k over keys and a row key only; the other columns are fetched for the k rows.

    The join's right side has k rows, a proven bound, so it is broadcast and
    the wide scan never sorts.
    """
    order = [asc(c) if ascending else desc(c) for c in keys] + [asc(c) for c in row_key]
    small = top_k(df.select(*dict.fromkeys([*row_key, *keys])), order, k).select(*row_key)
    return df.join(F.broadcast(small), row_key).orderBy(*order)


def with_group_totals(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Aggregates over whole partitions of few keys: combined before the shuffle and joined back, so no task holds a partition."""
    names = {k: f"__{k}" for k in keys}
    groups = df.groupBy(*[F.col(k).alias(names[k]) for k in keys]).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(groups, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])).drop(*names.values())


def with_running(df: DataFrame, partition: list[str], order: list[Column], sums: dict[str, Column] | None = None, rank: str | None = None, dense: str | None = None, row_number: str | None = None) -> DataFrame:
    """Running sums by rows, ranks and row numbers over few and large partitions.

    Rows are sorted by (partition, order) into ranges of about equal size; equal
    rows stand in one range. A range works out its own sums and ranks, and what
    the ranges before it add comes from one row per range and partition, of
    which there are at most the number of ranges plus that of partitions. Every
    sort key spells out where nulls go. The ranges are settled first, since
    two evaluations might cut them differently. Sums by rows need an order
    without ties.
    """
    ranged = settle(df.repartitionByRange(*[F.col(k).asc() for k in partition], *order).withColumn("__range", F.spark_partition_id()))
    own = Window.partitionBy("__range", *partition).orderBy(*order)
    rows = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = {name: c.over(rows) for name, c in (sums or {}).items()}
    ranks = {name: f().over(own).cast("bigint") for name, f in ((rank, F.rank), (dense, F.dense_rank), (row_number, F.row_number)) if name}
    local = ranged.select("*", *[c.alias(n) for n, c in (keyed | ranks).items()])
    # what a range adds to those after it: its sums, its rows, its distinct order keys
    adds = {n: c for n, c in (sums or {}).items()} | {n: F.count(F.lit(1)) for n in (rank, row_number) if n}
    if dense:
        adds[dense] = F.max(dense)
    ends = local.drop(*[n for n in (*(sums or {}), rank, row_number) if n]).groupBy("__range", *partition).agg(*[c.alias(f"__{n}") for n, c in adds.items()])
    before = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(F.col("__range").alias("__at"), *[F.col(k).alias(f"__key_{k}") for k in partition], *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in adds])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in partition], F.col("__range") == F.col("__at"))
    found = local.join(offsets, same)
    kinds = dict(local.dtypes)
    whole = {n: (F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0))).cast(kinds[n]) for n in adds}
    return found.select(*df.columns, *[c.alias(n) for n, c in whole.items()])
