"""Ranking functions and framed aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.operators.order import asc, desc, with_group_totals, with_running

from .registry import frame, quotient, sql

_O = "SELECT o_orderkey, o_custkey, o_orderstatus, @total AS v, o_totalprice FROM orders"

sql("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS r FROM orders")


@frame("win_rank_dense", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 50) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 50) AS BIGINT) AS d FROM orders")
def _(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 50).alias("k"))
    return with_running(orders, ["o_orderstatus"], [asc("k")], rank="r", dense="d").select("o_orderkey", "r", "d")


sql("win_running_sum_rows", f"SELECT o_orderkey, CAST(sum(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS s FROM ({_O}) t")
sql("win_running_range_peers", f"SELECT o_orderkey, CAST(sum(v) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS DECIMAL(38,2)) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS n FROM ({_O}) t")
sql("win_partition_total", f"SELECT o_orderkey, CAST(sum(v) OVER (PARTITION BY o_custkey) AS DECIMAL(38,2)) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM ({_O}) t")


@frame("win_sum_bigint_exact", "SELECT o_orderkey, CAST(sum(CAST(o_custkey AS DECIMAL(38,0))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,0)) AS s FROM orders")
def _(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return with_running(orders, ["o_orderstatus"], [asc("o_orderkey")], sums={"s": F.sum(F.col("o_custkey").cast("decimal(28,0)"))}).select("o_orderkey", "s")




@frame("win_avg", f"SELECT o_orderkey, {quotient('CAST(sum(v) OVER (PARTITION BY o_custkey) * 100 AS HUGEINT)', 'count(v) OVER (PARTITION BY o_custkey) * 100', 16)} AS a FROM ({_O}) t")
def _(t):
    return t("orders").select("o_orderkey", numeric.avg_over(F.col("o_totalprice").cast("decimal(15,2)"), Window.partitionBy("o_custkey")).alias("a"))


sql("win_minmax", f"SELECT o_orderkey, min(v) OVER (PARTITION BY o_custkey) AS lo, max(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS hi FROM ({_O}) t")
sql("win_count", "SELECT l_orderkey, l_linenumber, count(NULLIF(l_returnflag, 'A')) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem")
sql("win_topn_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3")
sql("win_over_agg", "SELECT o_orderstatus, CAST(s AS DECIMAL(38,2)) AS s, CAST(sum(s) OVER () AS DECIMAL(38,2)) AS total FROM (SELECT o_orderstatus, sum(@total) AS s FROM orders GROUP BY o_orderstatus) t")
sql("win_agg_nested", "SELECT l_returnflag, l_linestatus, CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")


@frame("win_chained", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS a, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS b FROM orders")
def _(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    ranked = with_running(orders, ["o_orderstatus"], [asc("o_custkey")], rank="b")
    return ranked.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint").alias("a"), "b")


@frame("win_null_order", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY NULLIF(o_custkey % 5, 2) DESC NULLS FIRST, o_orderkey) AS BIGINT) AS r, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY NULLIF(o_custkey % 5, 2) ASC NULLS LAST, o_orderkey) AS BIGINT) AS q FROM orders")
def _(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus", F.nullif(F.col("o_custkey") % 5, F.lit(2)).alias("k"))
    down = with_running(orders, ["o_orderstatus"], [desc("k"), asc("o_orderkey")], rank="r")
    return with_running(down, ["o_orderstatus"], [asc("k"), asc("o_orderkey")], rank="q").select("o_orderkey", "r", "q")


@frame("win_null_partition", "SELECT o_orderkey, count(*) OVER (PARTITION BY NULLIF(o_custkey % 5, 2)) AS n FROM orders")
def _(t):
    orders = t("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(2)).alias("k"))
    return with_group_totals(orders, ["k"], {"n": F.count(F.lit(1))}).select("o_orderkey", "n")


sql("win_offset_functions", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c FROM orders")
