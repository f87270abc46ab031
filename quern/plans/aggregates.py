"""Aggregates, distinct arguments and grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import numeric
from quern.operators import grouping, skew

from .registry import frame, quotient, sql

sql("agg_global", "SELECT count(*) AS n, count(NULLIF(l_linenumber, 1)) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
sql("agg_global_empty", "SELECT count(*) AS n, sum(l_linenumber) IS NULL AS s, max(l_quantity) AS hi FROM lineitem WHERE l_orderkey < 0")
sql("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_group_expression", "SELECT l_orderkey % 10 AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey % 10")
sql("agg_high_cardinality", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 7")
sql("agg_having", "SELECT o_custkey, CAST(sum(@total) AS DECIMAL(38,2)) AS s FROM orders GROUP BY o_custkey HAVING sum(@total) > 1500000 AND count(*) > 3")
sql("agg_sum_int", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_sum_decimal", "SELECT l_linestatus, CAST(sum(@price) AS DECIMAL(38,2)) AS s, CAST(sum(@rev) AS DECIMAL(38,4)) AS r FROM lineitem GROUP BY l_linestatus")


@frame("agg_sum_float", "SELECT l_linenumber, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_linenumber")
def _(t):
    return t("lineitem").groupBy("l_linenumber").agg(F.round(numeric.sum_float(F.col("l_quantity")), 2).alias("s"))


sql("agg_avg_float", "SELECT l_linenumber, round(avg(l_extendedprice), 4) AS a FROM lineitem GROUP BY l_linenumber")
sql("agg_minmax_all_types", "SELECT o_orderstatus, min(o_orderkey) AS a, max(o_orderpriority) AS b, min(@odate) AS c, max(@total) AS d, max(o_totalprice) AS e FROM orders GROUP BY o_orderstatus")
sql("agg_minmax_nan", "SELECT k, [[isnan(max(f))||isnan(max(f))]] AS hi, min(f) AS lo FROM (SELECT l_linenumber AS k, CASE WHEN l_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS f FROM lineitem) t GROUP BY k")
sql("agg_any", "SELECT c_custkey, any_value(c_name) AS nm, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("agg_distinct_one", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_distinct_sum_avg", "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS s, round(avg(DISTINCT o_custkey % 100), 6) AS a FROM orders GROUP BY o_orderstatus")
sql("agg_distinct_many", "SELECT l_linestatus, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey % 50) AS b, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_linestatus")
sql("agg_over_agg", "SELECT n, count(*) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
sql("agg_group_null_keys", "SELECT NULLIF(l_linenumber, 3) AS k, NULLIF(l_returnflag, 'A') AS f, count(*) AS n FROM lineitem GROUP BY NULLIF(l_linenumber, 3), NULLIF(l_returnflag, 'A')")
sql("agg_group_char", "SELECT rtrim(rpad(l_returnflag, 10, ' ')) AS k, count(*) AS n FROM lineitem GROUP BY rtrim(rpad(l_returnflag, 10, ' '))")
sql("agg_group_float_zero_nan", "SELECT count(*) AS groups, max(n) AS most FROM (SELECT f, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 * -1 WHEN 3 THEN CAST('NaN' AS DOUBLE) ELSE 1e0 END AS f FROM lineitem) t GROUP BY f) u")
sql("agg_mixed_scale_case", "SELECT l_returnflag, CAST(sum(CASE WHEN l_linenumber < 4 THEN CAST(@disc AS DECIMAL(15,4)) ELSE CAST(@price AS DECIMAL(15,4)) END) AS DECIMAL(38,4)) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_below_join", "SELECT c_nationkey, CAST(sum(t.s) AS DECIMAL(38,2)) AS s FROM customer JOIN (SELECT o_custkey, sum(@total) AS s FROM orders GROUP BY o_custkey) t ON c_custkey = o_custkey GROUP BY c_nationkey")
sql("agg_filter_clause", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY l_linestatus")

_EXACT = "SELECT l_returnflag, CAST(sum(CAST(l_partkey AS DECIMAL(38,0)) * 1000000000) AS DECIMAL(38,0)) AS s FROM lineitem GROUP BY l_returnflag"


@frame("agg_sum_bigint_exact", _EXACT)
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(numeric.sum_exact(F.col("l_partkey") * F.lit(1000000000)).alias("s"))


@frame("agg_avg_int", f"SELECT l_returnflag, {quotient('sum(l_linenumber)', 'count(*)', 16)} AS a FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(numeric.avg_exact(F.col("l_linenumber")).alias("a"))


@frame("agg_avg_decimal", f"SELECT l_returnflag, {quotient('CAST(sum(@price) * 100 AS HUGEINT)', 'count(*) * 100', 16)} AS a, {quotient('CAST(sum(-@price) * 100 AS HUGEINT)', 'count(*) * 100', 16)} AS b FROM lineitem GROUP BY l_returnflag")
def _(t):
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    return t("lineitem").groupBy("l_returnflag").agg(numeric.avg_exact(price).alias("a"), numeric.avg_exact(-price).alias("b"))


@frame("agg_stddev_variance", "SELECT l_returnflag, round(stddev_samp(l_linenumber), 8) AS ss, round(stddev_pop(l_linenumber), 8) AS sp, round(var_samp(l_linenumber), 8) AS vs, round(var_pop(l_linenumber), 8) AS vp FROM lineitem GROUP BY l_returnflag")
def _(t):
    x = F.col("l_linenumber")
    return t("lineitem").groupBy("l_returnflag").agg(
        F.round(numeric.stddev_exact(x), 8).alias("ss"),
        F.round(numeric.stddev_exact(x, False), 8).alias("sp"),
        F.round(numeric.variance_exact(x), 8).alias("vs"),
        F.round(numeric.variance_exact(x, False), 8).alias("vp"),
    )


_N, _S, _Q = "CAST(count(*) AS HUGEINT)", "CAST(sum(l_linenumber) AS HUGEINT)", "CAST(sum(l_linenumber * l_linenumber) AS HUGEINT)"


@frame("agg_variance_decimal", f"SELECT l_returnflag, {quotient(f'{_N} * {_Q} - {_S} * {_S}', f'{_N} * ({_N} - 1)', 16)} AS vs, {quotient(f'{_N} * {_Q} - {_S} * {_S}', f'{_N} * {_N}', 16)} AS vp FROM lineitem GROUP BY l_returnflag")
def _(t):
    x = F.col("l_linenumber")
    return t("lineitem").groupBy("l_returnflag").agg(numeric.variance_decimal(x).alias("vs"), numeric.variance_decimal(x, False).alias("vp"))


@frame("agg_stddev_single", "SELECT n_nationkey, var_samp(n_regionkey) IS NULL AS a, CAST(var_pop(n_regionkey) AS DOUBLE) AS b FROM nation GROUP BY n_nationkey")
def _(t):
    x = F.col("n_regionkey")
    return t("nation").groupBy("n_nationkey").agg(numeric.variance_exact(x).isNull().alias("a"), numeric.variance_exact(x, False).alias("b"))


@frame("agg_two_stage_avg", "SELECT l_returnflag, round(avg(l_quantity), 6) AS a, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    partial = [F.sum("l_quantity").alias("s"), F.count("l_quantity").alias("c")]
    final = [F.round(numeric.avg_merge(F.col("s"), F.col("c")), 6).alias("a"), numeric.count_merge(F.col("c")).alias("n")]
    return skew.two_stage(t("lineitem"), ["l_returnflag"], partial, final)



def _counts():
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("decimal(38,2)").alias("s")]


#: Counts and sums of finer groups add up; over no group a count is zero.
_ADD_UP = {"n": lambda n: F.coalesce(F.sum(n), F.lit(0)), "s": F.sum}

_GS = "count(*) AS n, CAST(sum(@price) AS DECIMAL(38,2)) AS s FROM lineitem"


@frame("gs_rollup", f"SELECT l_returnflag, l_linestatus, {_GS} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    keys = ["l_returnflag", "l_linestatus"]
    return grouping.grouping_sets(t("lineitem"), keys, grouping.rollup(keys), _counts(), merges=_ADD_UP)


@frame("gs_cube", f"SELECT l_returnflag, l_linestatus, l_linenumber, {_GS} GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def _(t):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return grouping.grouping_sets(t("lineitem"), keys, grouping.cube(keys), _counts(), merges=_ADD_UP)


@frame("gs_sets", f"SELECT l_returnflag, l_linestatus, l_linenumber, {_GS} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def _(t):
    return grouping.grouping_sets(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [["l_returnflag", "l_linestatus"], ["l_linenumber"], []], _counts(), merges=_ADD_UP)


@frame(
    "gs_duplicate_sets_group_id",
    "SELECT l_returnflag, count(*) AS n, 0 AS g FROM lineitem GROUP BY l_returnflag UNION ALL SELECT l_returnflag, count(*), 1 FROM lineitem GROUP BY l_returnflag UNION ALL SELECT NULL, count(*), 0 FROM lineitem UNION ALL SELECT NULL, count(*), 1 FROM lineitem",
)
def _(t):
    return grouping.grouping_sets(t("lineitem"), ["l_returnflag"], [["l_returnflag"], ["l_returnflag"], [], []], [F.count(F.lit(1)).alias("n")], group_id="g", merges={"n": _ADD_UP["n"]})


@frame("gs_grouping_fn", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    keys = ["l_returnflag", "l_linestatus"]
    return grouping.grouping_sets(t("lineitem"), keys, grouping.cube(keys), [F.count(F.lit(1)).alias("n")], grouping_id="gid", merges={"n": _ADD_UP["n"]})


@frame("gs_empty_input", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey < 0 GROUP BY GROUPING SETS ((l_returnflag), ())")
def _(t):
    return grouping.grouping_sets(t("lineitem").where("l_orderkey < 0"), ["l_returnflag"], [["l_returnflag"], []], [F.count(F.lit(1)).alias("n")], merges={"n": _ADD_UP["n"]})


sql("gs_null_data", "SELECT NULLIF(l_linenumber, 3) AS k, CAST(grouping(NULLIF(l_linenumber, 3)) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (NULLIF(l_linenumber, 3))")
sql("gs_having", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linenumber) HAVING count(*) > 500")
sql("gs_join", "SELECT n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)")
