"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.strings import char_key, char_pad
from quern.operators import skew, subquery

from .registry import frame, sql

_A = "(SELECT o_orderkey AS i, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 400 END AS k FROM orders) a"
_B = "(SELECT c_custkey AS j, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 300 + 150 END AS k FROM customer) b"

sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql("join_inner_residual", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice * 2 > o_totalprice AND l_shipdate > o_orderdate")
sql("join_left_filter_on", f"SELECT i, a.k AS k, j FROM {_A} LEFT JOIN {_B} ON a.k = b.k AND i > 500 AND j < 300")
sql("join_semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
sql("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = NULLIF(c_custkey, 7) AND o_totalprice > 100000)")
sql("join_not_in_null_aware", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
sql("join_not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 5) FROM orders)")
sql("join_not_in_empty", "SELECT c_custkey FROM customer WHERE NULLIF(c_custkey, 3) NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 0)")
sql("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey AND s_acctbal < n_nationkey * 100")
sql("join_theta_left", "SELECT s_suppkey, r_regionkey FROM supplier LEFT JOIN region ON s_nationkey < r_regionkey")
sql("join_theta_semi", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey * 400 > s_acctbal AND n_nationkey < s_nationkey)")
sql("join_theta_anti", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey * 400 > s_acctbal AND n_nationkey < s_nationkey)")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_multi_star", "SELECT n_name, p_type, count(*) AS n, CAST(sum(@rev) AS DECIMAL(38,4)) AS rev FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_type")
sql("join_key_widening", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_nationkey")
sql("join_float_key", "SELECT count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN 0e0 * -1 ELSE l_quantity END AS k FROM lineitem) a JOIN (SELECT CASE WHEN n_nationkey = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_nationkey AS DOUBLE) - 1 END AS k FROM nation) b ON a.k = b.k")
sql("join_dedup_semi", "SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity = 50")
sql("subq_scalar", "SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) - o_custkey AS d FROM orders")
sql("subq_scalar_empty", "SELECT r_regionkey, (SELECT max(c_custkey) FROM customer WHERE c_custkey < 0) AS v FROM region")
sql("subq_corr_count_zero", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS n FROM customer")
sql("subq_in_or", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_totalprice > 300000")


def _few_keys(t):
    """The sides of the outer and null-equal joins: 400 and 300 keys whatever the scale, so the pairs of a key grow with its square."""
    a = t("orders").select(F.col("o_orderkey").alias("i"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 400 END").alias("ak"))
    b = t("customer").select(F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 300 + 150 END").alias("bk"), F.col("c_custkey").alias("j"))
    return a, b


@frame("join_full", f"SELECT i, a.k AS ak, b.k AS bk, j FROM {_A} FULL JOIN {_B} ON a.k = b.k")
def _(t):
    return skew.blocked_join(*_few_keys(t), "ak", "bk", "full").select("i", "ak", "bk", "j")


@frame("join_left", f"SELECT i, a.k AS k, j FROM {_A} LEFT JOIN {_B} ON a.k = b.k")
def _(t):
    return skew.blocked_join(*_few_keys(t), "ak", "bk", "left").select("i", F.col("ak").alias("k"), "j")


@frame("join_right", f"SELECT i, b.k AS k, j FROM {_A} RIGHT JOIN {_B} ON a.k = b.k AND j % 2 = 0")
def _(t):
    return skew.blocked_join(*_few_keys(t), "ak", "bk", "right", F.expr("j % 2 = 0")).select("i", F.col("bk").alias("k"), "j")


@frame("join_null_equal", f"SELECT count(*) AS n, count(a.k) AS k FROM {_A} JOIN {_B} ON a.k IS NOT DISTINCT FROM b.k")
def _(t):
    # pairs are counted from the rows of each key, not listed
    a, b = _few_keys(t)
    a, b = a.groupBy("ak").agg(F.count(F.lit(1)).alias("x")), b.groupBy("bk").agg(F.count(F.lit(1)).alias("y"))
    pairs = F.col("x") * F.col("y")
    total = [F.coalesce(F.sum(p), F.lit(0)).cast("bigint").alias(c) for c, p in (("n", pairs), ("k", F.when(F.col("ak").isNotNull(), pairs)))]
    return a.join(b, F.col("ak").eqNullSafe(F.col("bk"))).agg(*total)


@frame("subq_corr_avg", "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity < (SELECT 0.3 * avg(b.l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)")
def _(t):
    # every row of a key is an outer row too, so one pass gives the average
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return subquery.with_correlated(lines, ["l_partkey"], {"mean": F.avg("l_quantity")}).where("l_quantity < 0.3 * mean").select("l_orderkey", "l_linenumber")


@frame("join_char_key", "SELECT l_orderkey, l_linenumber, s FROM lineitem JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) o ON l_linestatus = s")
def _(t):
    lines = t("lineitem").withColumn("padded", char_pad(F.col("l_linestatus"), 10))
    status = t("orders").select(F.col("o_orderstatus").alias("s")).distinct()
    # two values hold all lines
    lines, status = lines.select("l_orderkey", "l_linenumber", char_key(F.col("padded")).alias("key")), status.withColumn("key", char_key(F.col("s")))
    return skew.salted_join(lines, status, ["key"], salts=64).select("l_orderkey", "l_linenumber", "s")


@frame("join_broadcast_hint", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    # 25 nations whatever the scale
    return t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@frame("join_merge_hint", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def _(t):
    return t("orders").where("o_orderstatus = 'P'").join(t("lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@frame("join_shuffle_hash_hint", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40")
def _(t):
    return t("lineitem").where("l_quantity > 40").join(t("orders").hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@frame("join_salted_skew", "SELECT l_orderkey, l_linenumber, f FROM lineitem JOIN (SELECT 'A' AS l_returnflag, 1 AS f UNION ALL SELECT 'N', 2) x USING (l_returnflag)")
def _(t):
    flags = t("lineitem").select("l_returnflag").distinct().where("l_returnflag IN ('A', 'N')").withColumn("f", F.when(F.col("l_returnflag") == "A", 1).otherwise(2))
    return skew.salted_join(t("lineitem"), flags, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "f")


@frame("join_repartitioned", "SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def _(t):
    # one exchange of orders serves the join and the aggregate
    return t("orders").join(t("customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@frame("join_not_in_distributed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _(t):
    return subquery.null_aware_anti(t("customer").select("c_custkey"), "c_custkey", t("orders").where("o_totalprice > 250000").select("o_custkey"))


@frame("subq_in_value", "SELECT o_orderkey, NULLIF(o_custkey % 40, 3) IN (SELECT NULLIF(c_custkey % 30, 4) FROM customer) AS v, NULLIF(o_custkey % 40, 3) NOT IN (SELECT NULLIF(c_custkey % 30, 4) FROM customer) AS w FROM orders")
def _(t):
    values = t("customer").select(F.nullif(F.col("c_custkey") % 30, F.lit(4)).alias("m"))
    x = F.nullif(F.col("o_custkey") % 40, F.lit(3))
    out = subquery.in_set(t("orders"), x, values, "v")
    return out.select("o_orderkey", "v", (~F.col("v")).alias("w"))


@frame("subq_in_value_empty", "SELECT o_orderkey, NULLIF(o_custkey % 40, 3) IN (SELECT c_custkey FROM customer WHERE c_custkey < 0) AS v FROM orders")
def _(t):
    return subquery.in_set(t("orders"), F.nullif(F.col("o_custkey") % 40, F.lit(3)), t("customer").where("c_custkey < 0").select("c_custkey"), "v").select("o_orderkey", "v")


@frame("subq_scalar_of", "SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_nationkey = 7) AS v FROM region")
def _(t):
    return subquery.scalar_of(t("region").select("r_regionkey"), t("nation").where("n_nationkey = 7").select("n_name"), "v")


@frame("subq_key_filter", "SELECT CAST(sum(@price) AS DECIMAL(38,2)) AS s FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
def _(t):
    parts = t("part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("l_partkey"))
    wide = t("lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(parts, "l_partkey", "left_semi")
    lines = subquery.with_correlated(wide, ["l_partkey"], {"half": 0.5 * F.avg("l_quantity")}, t("lineitem").select("l_partkey", "l_quantity"))
    return lines.where("l_quantity < half").agg(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("decimal(38,2)").alias("s"))


# the side that looks large by its table is small once filtered: only the run shows which one to build on
sql("join_side_chosen_at_run_time", "SELECT o_orderkey, l_linenumber FROM lineitem JOIN (SELECT o_orderkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 AND o_orderpriority LIKE '1%' GROUP BY o_orderkey) o ON l_orderkey = o_orderkey")
