"""Session factory and the few settings the library relies on for speed (never for results)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and AQE.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` so that
    one partition is 100-200 MB; AQE coalesces what turns out smaller.
    """
    builder = SparkSession.builder.appName("quern")
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
