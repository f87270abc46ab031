"""Parquet tables as DataFrames and views; sinks for query results."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table; columns and filters that a query uses reach the scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def register(spark: SparkSession, base: str, names: list[str] | None = None) -> None:
    """Temporary views over the tables, for SQL text."""
    for name in names or TABLES:
        table(spark, base, name).createOrReplaceTempView(name)


def insert_select(query: DataFrame, target: str, mode: str = "append") -> DataFrame:
    """INSERT ... SELECT: append the rows of ``query`` to a Parquet table; returns what the table holds then.

    A query that reads its own target is planned on the files that were there
    before, so it does not see its own rows.
    """
    query.write.mode(mode).parquet(target)
    return query.sparkSession.read.parquet(target)


def create_as(query: DataFrame, target: str) -> DataFrame:
    """CREATE TABLE AS / SELECT INTO / materialized view: write once, read from then on."""
    return insert_select(query, target, "errorifexists")


def create_partitioned(query: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """A table with a folder per value of its keys; a filter on them reads only the folders it asks for.

    Rows go to their folder's task first, a few tasks per folder, so that no
    task writes to all folders.
    """
    tasks = query.withColumn("__task", F.pmod(F.monotonically_increasing_id(), F.lit(8)))
    tasks.repartition(*keys, "__task").drop("__task").write.mode("errorifexists").partitionBy(*keys).parquet(target)
    return query.sparkSession.read.parquet(target)


def with_row_id(df: DataFrame, name: str = "row_id", base: int = 0) -> DataFrame:
    """A distinct long per row, above ``base``; no shuffle and no order implied."""
    return df.withColumn(name, F.monotonically_increasing_id() + F.lit(base + 1))


def cached(df: DataFrame) -> DataFrame:
    """Columns kept decoded, compressed by column, in memory and beyond it on disk, once they have been read; ``unpersist`` frees them."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def catalog_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """The catalog as a table: the columns of each table (t, c) with their place (i) from one."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, c, i) for name, df in tables.items() for i, c in enumerate(df.columns, 1)]
    return spark.createDataFrame(rows, "t string, c string, i int")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one of this machine stands in only for local sessions."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (base or tempfile.mkdtemp(prefix="quern-")).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
