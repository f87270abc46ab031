"""Grouping sets that keep the row of an empty set and tell equal sets apart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, keys: list[str], sets: list[list[str]], aggregates: list[Column], group_id: str | None = None, grouping_id: str | None = None, merges: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Aggregate by several sets of keys at once.

    ``merges`` says for every aggregate, by its name, how its values of finer
    groups become that of a coarser one. The rows are then read and aggregated
    once, by all keys, and only the groups are expanded. Without it (distinct
    arguments, averages) the rows themselves are.

    Non-empty sets run in one pass (one Expand, one shuffle). An empty set is a
    plain aggregate, which returns its row even over no input. ``group_id``
    numbers equal sets from 0; ``grouping_id`` has one bit per key, 1 where the
    key is not part of the row's set.
    """
    kinds = dict(df.dtypes)
    if merges:
        df = df.groupBy(*keys).agg(*aggregates)
        aggregates = [merges[c](F.col(c)).cast(t).alias(c) for c, t in df.dtypes if c in merges]
    parts = []
    seen: dict[tuple, int] = {}
    rounds: list[list[list[str]]] = []
    for s in sets:
        if s:
            k = seen[tuple(sorted(s))] = seen.get(tuple(sorted(s)), -1) + 1
            while len(rounds) <= k:
                rounds.append([])
            rounds[k].append(s)
    for k, several in enumerate(rounds):
        part = df.groupingSets([[F.col(c) for c in s] for s in several], *[F.col(c) for c in keys])
        extra = ([F.lit(k).cast("int").alias(group_id)] if group_id else []) + ([F.grouping_id(*keys).cast("int").alias(grouping_id)] if grouping_id else [])
        parts.append(part.agg(*aggregates, *extra))
    for k in range(sum(not s for s in sets)):
        extra = ([F.lit(k).cast("int").alias(group_id)] if group_id else []) + ([F.lit(2 ** len(keys) - 1).cast("int").alias(grouping_id)] if grouping_id else [])
        total = df.agg(*aggregates)
        parts.append(total.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in keys], *[F.col(c) for c in total.columns], *extra))
    return reduce(DataFrame.unionByName, parts)


def rollup(keys: list[str]) -> list[list[str]]:
    return [keys[:n] for n in range(len(keys), -1, -1)]


def cube(keys: list[str]) -> list[list[str]]:
    return [[k for i, k in enumerate(keys) if bits >> (len(keys) - 1 - i) & 1] for bits in range(2 ** len(keys) - 1, -1, -1)]
