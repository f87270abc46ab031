"""Joins and sums on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on the left and on the right of ``blocked_join``, so pairs that one step of a task holds at most: their product.
LEFT_BLOCK, RIGHT_BLOCK = 512, 256
#: Left rows that one task of ``blocked_join`` expands, few enough for Parquet to keep a dictionary of them.
TASK_ROWS = 50_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join that deals each key of the left side over ``salts`` tasks.

    The right side is repeated once per salt, so it should be the side with few
    rows per key. Full and right outer joins would repeat unmatched rows and are refused.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")


def two_stage(df: DataFrame, keys: list[str], partial: list[Column], final: list[Column], salts: int = 16) -> DataFrame:
    """Aggregate by (key, salt) and then by key, for states that do not combine before the shuffle."""
    return df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(*keys, "__salt").agg(*partial).groupBy(*keys).agg(*final)


def _blocks(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """The rows of each (key, __deal) as arrays of at most ``size`` structs."""
    place = F.row_number().over(Window.partitionBy(key, "__deal").orderBy(key))
    rest = [c for c in df.columns if c not in (key, "__deal")]
    return df.withColumn("__block", F.floor((place - 1) / size)).groupBy(key, "__deal", "__block").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("__block")


def blocked_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", right_on: Column | None = None) -> DataFrame:
    """Equi-join on a key that repeats so much on both sides that its pairs are most of the work.

    A plain full outer join holds all pairs of a key in memory, and pairs that
    come out unordered are written at their full width. Here both sides become
    blocks of rows of one key; blocks meet, and a pair of blocks is expanded on
    its own. Each left row comes with the same run of right rows as the one
    before, which compresses well. The left rows of a key are dealt over tasks,
    whose number goes with the left rows; the right rows, best the fewer ones,
    are repeated 64 times at most.

    ``right_on`` is a condition of ON over the right side alone. Returns the
    columns of both sides, which must have distinct names.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"a blocked join cannot be {how}")
    context = left.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-left.count() // TASK_ROWS))
    salts = min(tasks, 64)
    row = F.monotonically_increasing_id()
    candidates = right.where(F.col(right_key).isNotNull() if right_on is None else F.col(right_key).isNotNull() & right_on)
    dealt = candidates.withColumn("__deal", F.pmod(row, F.lit(max(1, min(16, candidates.count() // TASK_ROWS)))))
    met = _blocks(dealt, right_key, RIGHT_BLOCK, "__rights").drop("__deal").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    outer = left.where(F.col(left_key).isNotNull()).withColumn("__deal", F.pmod(row, F.lit(salts)).cast("int"))
    blocks = _blocks(outer.repartition(tasks, left_key, "__deal"), left_key, LEFT_BLOCK, "__lefts")
    joined = blocks.join(met, (F.col(left_key) == F.col(right_key)) & (F.col("__deal") == F.col("__salt")))
    pairs = joined.select(left_key, right_key, F.explode("__lefts").alias("__left"), "__rights").select(left_key, right_key, "__left", F.explode("__rights").alias("__right"))
    out = pairs.select(*[left_key if c == left_key else F.col("__left")[c].alias(c) for c in left.columns], *[right_key if c == right_key else F.col("__right")[c].alias(c) for c in right.columns])
    if how in ("left", "full"):
        out = out.unionByName(_alone(left, F.col(left_key), candidates, right_key), allowMissingColumns=True)
    if how in ("right", "full"):
        key = F.col(right_key) if right_on is None else F.when(right_on, F.col(right_key))
        out = out.unionByName(_alone(right, key, left, left_key), allowMissingColumns=True)
    return out


def _alone(df: DataFrame, key: Column, others: DataFrame, other_key: str) -> DataFrame:
    """The rows whose key is null or not among the others', in tasks of their own: their distinct values would end the dictionaries of a file of pairs."""
    keys = others.where(F.col(other_key).isNotNull()).select(F.col(other_key).alias("__key")).distinct()
    return salted_join(df.withColumn("__key", key), keys, ["__key"], how="left_anti").drop("__key")
