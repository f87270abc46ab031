"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A temporary folder of this machine stands in only where driver and
    executors are one process, as in tests; anywhere else the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="quern-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """64-bit hashes of the hot keys (__hot) and over how many tasks each is dealt (__salts).

    A key is hot if it has more rows than an even share of one of the shuffle
    partitions, so there are fewer hot keys than partitions, whatever the table.
    """
    n = shuffle_partitions(rows.sparkSession)
    sizes = rows.groupBy(F.xxhash64(*keys).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__total"))
    share = F.col("__n") * F.lit(float(n)) / F.col("__total")
    return checkpoint(sizes.join(F.broadcast(total), share > 1).select("__hot", F.ceil(share).cast("int").alias("__salts")))


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], spread: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join rows with facts (few rows per key) where a key may have a large share of all rows.

    Rows of a hot key are dealt over as many tasks as its rows are worth by a
    hash of the column ``spread``, and the facts of that key are repeated for
    each. Only hashes of hot keys are broadcast; a chance hit there only deals
    one more key. ``how`` is inner or left. ``rows`` is read twice and should be
    cheap to read, unless its ``hot_keys`` are given. The merge join is asked
    for, since a join moved to where the facts lie would undo the dealing.
    """
    hot = hot_keys(rows, keys) if hot is None else hot
    is_hot = F.xxhash64(*keys) == F.col("__hot")
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(spread, F.lit("salt")), F.col("__salts")).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), is_hot, "left").withColumn("__salt", salt).drop("__hot", "__salts")
    every = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    repeated = facts.join(F.broadcast(hot), is_hot, "left").withColumn("__salt", F.explode(every)).drop("__hot", "__salts")
    return dealt.hint("merge").join(repeated, [*keys, "__salt"], how).drop("__salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, as (node, component).

    ``edges`` has long columns ``a`` and ``b``. Every round takes the smallest
    label among neighbours and then the label of that label (pointer jumping),
    so stars and chains shrink geometrically. Nothing but one count per round
    comes to the driver. Hubs and the labels of large components are dealt over
    several tasks; minima are combined before the shuffle.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    hubs = hot_keys(both, ["b"])
    while True:
        near = join_hot(both, labels.select(F.col("node").alias("b"), "component"), ["b"], "a", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = checkpoint(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        parent = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = join_hot(hooked, parent, ["component"], "node").select("node", "old", F.least("component", "up").alias("component"))
        jumped = checkpoint(jumped)
        moved = jumped.where("old <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if not moved:
            return labels
