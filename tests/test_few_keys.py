"""Joins and set operations on a few keys that hold all rows: same rows as plain ones, no task with all of a key."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import skew
from quern.operators.diagnostics import node_rows
from quern.plans import catalog

QUERIES = catalog.queries()


@pytest.fixture
def settings(spark):
    """Settings of the session for one test: no broadcast, which hides at small sizes what large ones do."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def joins(df):
    return [(name, rows) for _, name, rows in node_rows(df) if "Join" in name]


@pytest.mark.parametrize("right_on", [None, "y % 3 = 0"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_blocked_join_equals_plain(spark, monkeypatch, how, right_on):
    for name, size in (("LEFT_BLOCK", 7), ("RIGHT_BLOCK", 5), ("TASK_ROWS", 60)):
        monkeypatch.setattr(skew, name, size)
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice([None, 1, 1, 1, 2, 3, 9]), x % 90 or None, str(x)) for x in range(200)], "a long, x int, s string")
    right = spark.createDataFrame([(rng.choice([None, 1, 1, 2, 3, 4]), y % 70 or None) for y in range(150)], "b long, y int")
    on = F.col("a") == F.col("b")
    on = on if right_on is None else on & F.expr(right_on)
    for lefts, rights in ((left, right), (left.where("x < 0"), right), (left, right.where("y < 0")))[: 3 if right_on is None else 1]:
        got = skew.blocked_join(lefts, rights, "a", "b", how, None if right_on is None else F.expr(right_on)).select("a", "x", "s", "b", "y")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, lefts.join(rights, on, how).select("a", "x", "s", "b", "y").collect()))


def test_blocked_join_refuses_other_kinds(spark):
    with pytest.raises(ValueError):
        skew.blocked_join(spark.range(1), spark.range(1).toDF("b"), "id", "b", "left_semi")


def test_full_join_does_not_hold_the_pairs_of_a_key(spark, data):
    assert "FullOuter" not in QUERIES["join_full"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert max(rows for _, rows in joins(QUERIES["join_full"](spark, "/root/testdata/sf0.01")) if rows is not None) < 20_000  # of 40,396, 25,000 of them pairs


@pytest.mark.parametrize("name", ["join_left", "join_right"])
def test_outer_joins_write_their_pairs_narrow(spark, tmp_path, name):
    QUERIES[name](spark, "/root/testdata/sf0.1").write.parquet(str(tmp_path / name))
    files = list(Path(tmp_path / name).glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 1.5 * spark.read.parquet(str(tmp_path / name)).count()


def test_null_equal_join_lists_no_pairs(spark, data):
    assert all(rows <= 401 for _, rows in joins(QUERIES["join_null_equal"](spark, data)))


def test_intersect_meets_distinct_values(spark, data, settings):
    assert all(rows <= 8 for _, rows in joins(QUERIES["set_nulls_equal"](spark, data)))


def test_char_keys_are_dealt_over_tasks(spark, data, settings):
    counts = [r[1] for r in QUERIES["join_char_key"](spark, data).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 8 and max(counts) < sum(counts) / 4
