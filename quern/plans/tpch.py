"""End-to-end decision-support queries in the shape of TPC-H, adapted to the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import subquery

from .registry import frame, sql

_D = "DECIMAL(38,4)"
_PS = "(SELECT l_partkey AS pk, l_suppkey AS sk, min(@price) AS cost, CAST(sum(l_linenumber) AS BIGINT) AS avail FROM lineitem GROUP BY l_partkey, l_suppkey)"

def _limbs(x: str) -> str:
    """Exact sum of a BIGINT expression as DECIMAL(38,0), by two BIGINT sums that cannot overflow, so that rows stay off wide decimals."""
    return f"(CAST(sum({x} div 1000000) AS DECIMAL(31,0)) * 1000000 + CAST(sum({x} % 1000000) AS DECIMAL(31,0)))"


def _scaled(x: str, scale: int) -> str:
    return f"CAST(CAST({_limbs(x)} AS DECIMAL(31,0)) * CAST(1e-{scale} AS DECIMAL({scale},{scale})) AS DECIMAL(38,{scale}))"


_Q1 = "FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01 00:00:00'"
#: Cents and hundredths as BIGINT; the data has two decimals, so rounding gives what the exact columns hold.
_CENTS = f"(SELECT l_returnflag, l_linestatus, CAST(round(l_quantity * 100) AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t {_Q1}) c"
sql(
    "tpch_q1",
    f"[[SELECT l_returnflag, l_linestatus, {_scaled('q', 2)} AS sum_qty, {_scaled('p', 2)} AS sum_base_price, {_scaled('(p * (100 - d))', 4)} AS sum_disc_price, {_scaled('(p * (100 - d) * (100 + t))', 6)} AS sum_charge, "
    f"round(CAST({_scaled('q', 2)} AS DOUBLE) / count(*), 6) AS avg_qty, round(CAST({_scaled('p', 2)} AS DOUBLE) / count(*), 6) AS avg_price, round(CAST({_scaled('d', 2)} AS DOUBLE) / count(*), 8) AS avg_disc, count(*) AS count_order FROM {_CENTS}"
    "||SELECT l_returnflag, l_linestatus, CAST(sum(@qty) AS DECIMAL(38,2)) AS sum_qty, CAST(sum(@price) AS DECIMAL(38,2)) AS sum_base_price, CAST(sum(@rev) AS DECIMAL(38,4)) AS sum_disc_price, "
    "CAST(sum(CAST(@rev * CAST(1 + @tax AS DECIMAL(5,2)) AS DECIMAL(30,6))) AS DECIMAL(38,6)) AS sum_charge, round(CAST(sum(@qty) AS DOUBLE) / count(*), 6) AS avg_qty, round(CAST(sum(@price) AS DOUBLE) / count(*), 6) AS avg_price, "
    f"round(CAST(sum(@disc) AS DOUBLE) / count(*), 8) AS avg_disc, count(*) AS count_order {_Q1}]] GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
)


@frame(
    "tpch_q2",
    f"SELECT s_suppkey, s_name, n_name, p_partkey, cost FROM part JOIN {_PS} ps ON p_partkey = pk JOIN supplier ON s_suppkey = sk JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    f"WHERE p_size < 15 AND p_type LIKE '%E%' AND r_name = 'EUROPE' AND cost = (SELECT min(b.cost) FROM {_PS} b JOIN supplier s2 ON s2.s_suppkey = b.sk JOIN nation n2 ON s2.s_nationkey = n2.n_nationkey JOIN region r2 ON n2.n_regionkey = r2.r_regionkey WHERE b.pk = p_partkey AND r2.r_name = 'EUROPE') "
    "ORDER BY cost DESC, s_suppkey, p_partkey LIMIT 100",
)
def _(t):
    # parts and suppliers stand below the aggregate; the minimum per part comes from the same pass
    europe = t("region").where("r_name = 'EUROPE'").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")
    parts = t("part").where("p_size < 15 AND p_type LIKE '%E%'").select(F.col("p_partkey").alias("l_partkey"))
    lines = subquery.key_filter(t("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice"), ["l_partkey"], parts).join(europe, "l_suppkey")
    offers = lines.groupBy("l_partkey", "l_suppkey", "s_name", "n_name").agg(F.min(F.col("l_extendedprice").cast("decimal(15,2)")).alias("cost"))
    best = subquery.with_correlated(offers, ["l_partkey"], {"least": F.min("cost")}).where("cost = least")
    return best.select(F.col("l_suppkey").alias("s_suppkey"), "s_name", "n_name", F.col("l_partkey").alias("p_partkey"), "cost").orderBy(F.desc("cost"), "s_suppkey", "p_partkey").limit(100)


sql("tpch_q3", f"SELECT l_orderkey, CAST(sum(@rev) AS {_D}) AS revenue, @odate AS o_date FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, @odate ORDER BY revenue DESC, o_date, l_orderkey LIMIT 10")
sql("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-07-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority")
sql("tpch_q5", f"SELECT n_name, CAST(sum(@rev) AS {_D}) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY n_name ORDER BY revenue DESC, n_name")
sql("tpch_q6", f"SELECT CAST(sum(@price * @disc) AS {_D}) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND @disc BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql("tpch_q7", f"SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(sum(@rev) AS {_D}) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE ((a.n_name = 'NATION_3' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_3')) AND l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00' GROUP BY a.n_name, b.n_name, CAST(year(l_shipdate) AS BIGINT)")
sql("tpch_q8", f"SELECT y, round(CAST(sum(CASE WHEN nation = 'NATION_2' THEN v ELSE 0 END) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 8) AS share FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(@rev AS DECIMAL(30,4)) AS v, b.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') t GROUP BY y")
sql("tpch_q9", f"SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CAST(@rev AS DECIMAL(30,4)) - CAST(CAST(p_retailprice AS DECIMAL(15,2)) * @qty AS DECIMAL(30,4))) AS {_D}) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%blue%' GROUP BY n_name, CAST(year(o_orderdate) AS BIGINT)")
sql("tpch_q10", f"SELECT c_custkey, c_name, n_name, CAST(sum(@rev) AS {_D}) AS revenue, @cbal AS bal FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name, @cbal ORDER BY revenue DESC, c_custkey LIMIT 20")
sql("tpch_q11", "SELECT l_partkey, CAST(sum(@price) AS DECIMAL(38,2)) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 7 GROUP BY l_partkey HAVING sum(@price) > (SELECT CAST(sum(@price) AS DECIMAL(30,2)) * CAST(0.002 AS DECIMAL(4,3)) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 7)")
sql("tpch_q12", "SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_returnflag")
sql("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URG%' GROUP BY c_custkey) t GROUP BY c_count ORDER BY custdist DESC, c_count DESC")
sql("tpch_q14", "SELECT round(100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN CAST(@rev AS DECIMAL(30,4)) ELSE 0 END) AS DOUBLE) / CAST(sum(@rev) AS DOUBLE), 8) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1998-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-12-01 00:00:00'")
sql("tpch_q15", f"WITH r AS (SELECT l_suppkey AS k, CAST(sum(@rev) AS {_D}) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey) SELECT s_suppkey, s_name, v FROM supplier JOIN r ON s_suppkey = k WHERE v = (SELECT max(v) FROM r)")
sql("tpch_q16", "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (1, 4, 9, 14, 19, 23, 36, 45) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size")

@frame("tpch_q17", "SELECT round(CAST(sum(@price) AS DOUBLE) / 7.0, 6) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' AND l_quantity < (SELECT 0.4 * avg(b.l_quantity) FROM lineitem b WHERE b.l_partkey = p_partkey)")
def _(t):
    parts = t("part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"))
    lines = subquery.key_filter(t("lineitem").select("l_partkey", "l_quantity", "l_extendedprice"), ["l_partkey"], parts)
    few = subquery.with_correlated(lines, ["l_partkey"], {"mean": F.avg("l_quantity")}).where("l_quantity < 0.4 * mean")
    return few.agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double") / 7.0, 6).alias("avg_yearly"))


sql("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, @odate AS o_date, @total AS price, CAST(sum(@qty) AS DECIMAL(38,2)) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(@qty) > 250) GROUP BY c_name, c_custkey, o_orderkey, @odate, @total ORDER BY price DESC, o_date, o_orderkey LIMIT 100")
sql("tpch_q19", f"SELECT CAST(sum(@rev) AS {_D}) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)")

@frame("tpch_q20", f"SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 12 AND s_suppkey IN (SELECT sk FROM {_PS} ps WHERE pk IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND avail > (SELECT 0.1 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps.pk AND l_suppkey = ps.sk))")
def _(t):
    parts = t("part").where("p_name LIKE 'blue%'").select(F.col("p_partkey").alias("l_partkey"))
    lines = subquery.key_filter(t("lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), ["l_partkey"], parts)
    stock = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_linenumber").alias("avail"), F.sum("l_quantity").alias("sold")).where("avail > 0.1 * sold")
    wanted = t("supplier").where("s_nationkey < 12").select("s_suppkey", "s_name")
    return wanted.join(stock.select(F.col("l_suppkey").alias("s_suppkey")).distinct(), "s_suppkey", "left_semi")


sql("tpch_q21", "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey WHERE o_orderstatus = 'F' AND a.l_shipdate > o_orderdate + INTERVAL '60' DAY AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_quantity > 45) GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100")
sql("tpch_q22", "SELECT code, count(*) AS numcust, CAST(sum(bal) AS DECIMAL(38,2)) AS total FROM (SELECT substring(c_name, char_length(c_name), 1) AS code, @cbal AS bal FROM customer WHERE substring(c_name, char_length(c_name), 1) IN ('1', '3', '5', '7') AND @cbal > (SELECT CAST(avg(c_acctbal) AS DECIMAL(15,2)) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)) t GROUP BY code")
