"""Scans, projections, predicates, sorts, limits, set operations and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.operators import control
from quern.operators.order import asc, desc, top_k, top_k_late
from quern.sources.tables import cached, catalog_columns, create_as, create_partitioned, insert_select, shared_folder, with_row_id

from .registry import frame, sql

sql("scan_project", "SELECT l_orderkey, l_linenumber, @price AS price, @price * 2 AS twice FROM lineitem")
sql("scan_filter_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900 AND l_quantity < 24")
sql("scan_empty", "SELECT l_orderkey, l_partkey FROM lineitem WHERE 1 = 0")
sql("scan_one_time_filter", "SELECT count(*) AS n FROM lineitem WHERE 1 = 0")
sql("scan_like_pushdown", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%' AND p_size > 10")
sql("scan_prefilter_dates", "SELECT l_orderkey, l_linenumber, @ship AS d FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-02-01 00:00:00' AND l_returnflag IN ('A', 'R')")
sql("cte_shared_scan", "WITH f AS (SELECT l_suppkey AS k, sum(@rev) AS r FROM lineitem GROUP BY l_suppkey) SELECT a.k, CAST(a.r AS DECIMAL(38,4)) AS r FROM f a WHERE a.r >= (SELECT max(b.r) FROM f b) ")
sql("subquery_scan", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 12")
sql("pred_compare", "SELECT o_orderkey FROM orders WHERE o_custkey <> 5 AND o_orderkey >= 10 AND o_totalprice > 1000 AND o_orderstatus < 'P'")
sql("pred_and_or_guard", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber > 1 THEN 12 [[div||//]] (l_linenumber - 1) ELSE 0 END >= 4 OR l_quantity > 48")
sql("pred_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_custkey % 3 = 0)")
sql("pred_is_null", "SELECT l_orderkey, l_linenumber, NULLIF(l_linenumber, 3) IS NULL AS a, NULLIF(l_linenumber, 3) IS NOT NULL AS b FROM lineitem")
sql("pred_is_distinct", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') IS DISTINCT FROM NULLIF(o_orderstatus, 'O') AS d, NULLIF(o_orderstatus, 'F') IS NOT DISTINCT FROM 'O' AS e FROM orders")
sql("pred_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 14) AND p_brand NOT IN ('Brand#1', 'Brand#2')")
sql("pred_not_in_null", "SELECT l_orderkey, l_linenumber, NULLIF(l_linenumber, 2) IN (1, 3) AS a, l_linenumber NOT IN (1, NULL) AS b FROM lineitem")
sql("pred_between", "SELECT count(*) AS n FROM lineitem WHERE @disc BETWEEN 0.05 AND 0.07 AND l_shipdate NOT BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-01-01 00:00:00'")
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS c FROM orders")
sql("case_simple", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS c FROM lineitem")
sql("coalesce_nullif", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'O'), NULLIF(o_orderpriority, '1-URGENT'), 'none') AS c FROM orders")
sql("literals_typed", "SELECT r_regionkey, true AS b, CAST(1 AS BIGINT) AS i, CAST(1.50 AS DECIMAL(5,2)) AS n, 'it''s' AS t, DATE '2020-02-29' AS d, CAST('Infinity' AS DOUBLE) > 1e308 AS f FROM region")
sql("param_init_plan", "SELECT o_orderkey FROM orders WHERE @total > (SELECT CAST(avg(@total) AS DECIMAL(15,2)) * 1.5 FROM orders)")
sql("date_vs_timestamp", "SELECT count(*) AS n FROM orders WHERE @odate > TIMESTAMP '1996-05-05 12:00:00'")
sql("ratio_compare", "SELECT o_orderkey, CASE WHEN @total - CAST(1000.50 AS DECIMAL(15,2)) * (o_custkey % 9 + 1) > 0 THEN 1 WHEN @total - CAST(1000.50 AS DECIMAL(15,2)) * (o_custkey % 9 + 1) < 0 THEN -1 ELSE 0 END AS s FROM orders")


@frame("assert_single_row", "SELECT o_orderkey, o_orderstatus AS s FROM orders")
def _(t):
    return t("orders").select("o_orderkey", control.assert_true(F.col("o_orderkey") >= 0, "key below zero", F.col("o_orderstatus")).alias("s"))


@frame("row_id_unique", "SELECT count(*) AS n, count(*) AS d FROM orders")
def _(t):
    return with_row_id(t("orders").select("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("d"))


@frame("system_columns", "SELECT count(*) AS n FROM part")
def _(t):
    rows = t("part").select("p_partkey", "_metadata.file_name", F.spark_partition_id().alias("p"))
    return rows.where("file_name IS NOT NULL AND p >= 0").agg(F.count(F.lit(1)).alias("n"))


sql("sort_nulls", "SELECT k, i FROM (SELECT NULLIF(o_custkey % 7, 3) AS k, o_orderkey AS i FROM orders) t ORDER BY k ASC NULLS LAST, i")
sql("sort_desc_nulls_first", "SELECT k, i FROM (SELECT NULLIF(o_custkey % 7, 3) AS k, o_orderkey AS i FROM orders) t ORDER BY k DESC NULLS FIRST, i")
sql("sort_desc_nulls_last", "SELECT k, i FROM (SELECT NULLIF(o_custkey % 7, 6) AS k, o_orderkey AS i FROM orders) t ORDER BY k DESC NULLS LAST, i")
sql("sort_text_bytes", "SELECT c_name, c_custkey FROM customer ORDER BY c_mktsegment, c_name DESC, c_custkey")
sql("sort_float_special", "SELECT i, CAST(rank() OVER (ORDER BY f, i) AS BIGINT) AS r FROM (SELECT n_nationkey AS i, CASE n_nationkey % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN 0.0e0 ELSE CAST('-Infinity' AS DOUBLE) END AS f FROM nation) t")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25 OFFSET 40")
sql("limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
sql("topk_groups", "SELECT o_custkey, CAST(sum(@total) AS DECIMAL(38,2)) AS s FROM orders GROUP BY o_custkey ORDER BY s DESC, o_custkey LIMIT 5")
sql("sort_by_avg", "SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag, l_linenumber ORDER BY a DESC, 1, 2 LIMIT 8")
sql("topk_with_ties", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey) t WHERE r <= 10")


@frame("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10")
def _(t):
    return top_k(t("orders").select("o_orderkey", "o_totalprice"), [desc("o_totalprice"), asc("o_orderkey")], 10)


@frame("topk_late_materialized", "SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def _(t):
    return top_k_late(t("orders"), ["o_totalprice"], 20, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")


sql("set_union_all", "SELECT o_orderstatus AS s FROM orders UNION ALL SELECT l_linestatus FROM lineitem")
sql("set_union_all_widen", "SELECT o_custkey AS k, CAST(o_totalprice AS DECIMAL(15,4)) AS v FROM orders UNION ALL SELECT CAST(s_nationkey AS BIGINT), CAST(@sbal AS DECIMAL(15,4)) FROM supplier")
sql("set_union", "SELECT o_orderstatus AS s FROM orders UNION SELECT l_linestatus FROM lineitem UNION SELECT c_mktsegment FROM customer")
sql("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
sql("set_three_way", "(SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
sql("set_intersect_all", "SELECT o_orderstatus AS s FROM orders INTERSECT ALL SELECT l_linestatus FROM lineitem")
sql("set_except_all", "SELECT o_orderpriority AS s FROM orders EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")


@frame("set_nulls_equal", "SELECT NULLIF(l_linenumber, 2) AS k FROM lineitem INTERSECT SELECT NULLIF(CAST(o_custkey % 5 AS INT), 2) FROM orders")
def _(t):
    # a few values whatever the scale: each side is made distinct where it is read, so no task gets all rows of one value
    lines = t("lineitem").select(F.expr("NULLIF(l_linenumber, 2)").alias("k")).distinct()
    return lines.intersect(t("orders").select(F.expr("NULLIF(CAST(o_custkey % 5 AS INT), 2)").alias("k")).distinct())


@frame("set_partitioned_append", "SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS s, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1997, 1999) GROUP BY 1, 2")
def _(t):
    orders = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"))
    whole = create_partitioned(orders, _target(orders.sparkSession, "years"), ["y"])
    return whole.where("y IN (1997, 1999)").groupBy("y", "s").agg(F.count(F.lit(1)).alias("n"))


sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, NULLIF(l_linenumber, 4) AS n FROM lineitem")


def _target(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@frame("sink_ctas_roundtrip", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey")
def _(t):
    orders = t("orders")
    return create_as(orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), _target(orders.sparkSession, "ctas"))


@frame("sink_insert_select", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    target = _target(orders.sparkSession, "insert")
    return insert_select(create_as(orders, target).where("o_orderstatus = 'F'"), target)


@frame("catalog_columns", "SELECT table_name AS t, column_name AS c, CAST(ordinal_position AS INT) AS i FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'orders', 'lineitem')")
def _(t):
    return catalog_columns({name: t(name) for name in ("region", "nation", "customer", "orders", "lineitem")})


@frame("scan_cached_columns", "SELECT l_returnflag AS f, count(*) AS n, CAST(sum(@qty) AS DECIMAL(38,2)) AS q, (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS big FROM lineitem GROUP BY l_returnflag")
def _(t):
    kept = cached(t("lineitem").select("l_returnflag", F.col("l_quantity").cast("decimal(15,2)").alias("q")))
    big = kept.where("q > 25").agg(F.count(F.lit(1)).alias("big"))
    # one row
    return kept.groupBy(F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum("q").cast("decimal(38,2)").alias("q")).crossJoin(F.broadcast(big))


sql("sort_merged_streams", "SELECT k, v FROM (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, -c_custkey FROM customer) t ORDER BY k, v")
sql("set_merge_append", "SELECT count(*) AS n, max(k) AS hi FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier) t")
sql("output_tail", "SELECT c_custkey, md5(c_name) AS h, @cbal * 2 AS twice FROM customer WHERE c_acctbal > 0")
