"""Arithmetic, casts, strings, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dates, numeric, strings

from .registry import frame, quotient, sql

sql("num_int_div_mod", "SELECT l_orderkey, l_linenumber, CAST((l_partkey - 700) [[div||//]] 7 AS BIGINT) AS q, (l_partkey - 700) % 7 AS m FROM lineitem")
sql("num_decimal_add_mul", "SELECT l_orderkey, l_linenumber, CAST(@price + @tax AS DECIMAL(18,2)) AS a, CAST(@price * @disc AS DECIMAL(20,4)) AS m, CAST(@price - @disc AS DECIMAL(18,2)) AS d FROM lineitem")
sql("num_abs_round", "SELECT c_custkey, abs(@cbal) AS a, CAST(round(@cbal, 1) AS DECIMAL(15,1)) AS r, CAST(round(@cbal, 0) AS DECIMAL(15,0)) AS z FROM customer")


@frame("num_float_arith", "SELECT l_orderkey, l_linenumber, round(l_quantity * 1.5e0 + l_tax - l_discount / 3e0, 9) AS v FROM lineitem")
def _(t):
    q, x, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.float_checked(q * 1.5 + x - d / 3.0, q, x, d), 9).alias("v"))


sql("num_greatest", "SELECT s_suppkey, greatest(s_nationkey, CAST(10 AS INT)) AS g FROM supplier")
sql("num_rescale", "SELECT c_custkey, CAST(@cbal AS DECIMAL(20,5)) AS r FROM customer")
sql("cast_decimal_typmod", "SELECT c_custkey, CAST(@cbal AS DECIMAL(12,1)) AS r FROM customer")
sql("cast_widening", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS b, CAST(n_nationkey AS DOUBLE) AS d, CAST(n_nationkey AS DECIMAL(10,0)) AS n, CAST(n_nationkey AS SMALLINT) AS s FROM nation")
sql("cast_date_ts", "SELECT o_orderkey, @odate AS d, CAST(CAST(@odate AS [[TIMESTAMP_NTZ||TIMESTAMP]]) AS DATE) = @odate AS same FROM orders")


@frame("num_decimal_div", f"SELECT o_orderkey, {quotient('CAST(@total * 100 AS HUGEINT)', '370', 16)} AS q, {quotient('-CAST(@total * 100 AS HUGEINT)', '700', 16)} AS r FROM orders")
def _(t):
    total = F.col("o_totalprice").cast("decimal(15,2)")
    return t("orders").select("o_orderkey", numeric.divide_decimal(total, F.lit("3.7").cast("decimal(4,1)")).alias("q"), numeric.divide_decimal(-total, F.lit(7).cast("decimal(4,0)")).alias("r"))


@frame("num_overflow_try", "SELECT r_regionkey, CAST(NULL AS INT) AS v FROM region")
def _(t):
    return t("region").select("r_regionkey", F.try_add(F.lit(2147483647), F.col("r_regionkey").cast("int") + 1).alias("v"))


@frame("num_ratio_compare", "SELECT o_orderkey, CASE WHEN @total > CAST(1000 AS DECIMAL(15,2)) * (o_custkey % 9 + 1) THEN 1 WHEN @total < CAST(1000 AS DECIMAL(15,2)) * (o_custkey % 9 + 1) THEN -1 ELSE 0 END AS s FROM orders")
def _(t):
    b = (F.col("o_custkey") % 9 + 1).cast("decimal(5,0)")
    return t("orders").select("o_orderkey", numeric.ratio_compare(F.col("o_totalprice").cast("decimal(15,2)"), b, F.lit(1000).cast("decimal(15,2)")).alias("s"))


@frame("cast_float_int", "SELECT c_custkey, CAST(c_acctbal / 2e0 AS INT) AS i FROM customer")
def _(t):
    return t("customer").select("c_custkey", numeric.float_to_int(F.col("c_acctbal") / 2).alias("i"))


@frame("cast_decimal_int", "SELECT c_custkey, CAST(@cbal AS INT) AS i FROM customer")
def _(t):
    return t("customer").select("c_custkey", numeric.decimal_to_int(F.col("c_acctbal").cast("decimal(15,2)")).alias("i"))


@frame("cast_double_float", "SELECT c_custkey, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS f FROM customer")
def _(t):
    return t("customer").select("c_custkey", numeric.double_to_float(F.col("c_acctbal")).cast("double").alias("f"))


sql("str_length", "SELECT doc_id, CAST(char_length(text) AS INT) AS n, CAST([[octet_length(text)||strlen(text)]] AS INT) AS b FROM documents")
sql("str_pad", "SELECT p_partkey, lpad(p_name, 6, '*') AS a, rpad(p_name, 30, 'xy') AS b FROM part")
sql("str_trim", "SELECT p_partkey, [[btrim(concat('xx', p_name, 'xx'), 'x')||trim(concat('xx', p_name, 'xx'), 'x')]] AS a, ltrim(concat('  ', p_name)) AS b, rtrim(concat(p_name, '  ')) AS c FROM part")
sql("str_concat", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, NULLIF(c_name, c_name) || 'x' AS b FROM customer")
sql("str_strpos_replace", "SELECT p_partkey, CAST([[position('a' IN p_name)||strpos(p_name, 'a')]] AS INT) AS a, replace(p_name, 'an', 'AN') AS b FROM part")
sql("str_split_part", "SELECT page_id, split_part(url, '/', 3) AS a, split_part(url, '/', -1) AS b, split_part(url, '|', 2) AS c FROM pages")
sql("str_reverse_repeat", "SELECT p_partkey, reverse(p_name) AS a, repeat(p_brand, 2) AS b, repeat(p_brand, -1) AS c FROM part")
sql("str_starts_with", "SELECT p_partkey, [[startswith(p_name, 'b')||starts_with(p_name, 'b')]] AS a FROM part")
sql("str_like", "SELECT p_partkey, p_name LIKE '%an%il' AS a, p_name NOT LIKE '_l%' AS b FROM part")
sql("str_like_multibyte", "SELECT doc_id FROM documents WHERE text LIKE '%é%' AND text NOT LIKE '%ü%'")
sql("str_char_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE rtrim(rpad(l_returnflag, 10, ' ')) = 'A' AND rpad(l_linestatus, 4, ' ') LIKE 'F%'")
sql("str_group_split", "SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY split_part(url, '/', 3)")


@frame("str_substr", "SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, 1, 1) AS b, substr(p_name, 1, 2) AS c, substr(p_name, 3) AS d, '' AS e FROM part")
def _(t):
    s = F.col("p_name")
    return t("part").select(
        "p_partkey",
        strings.substr(s, F.lit(2), F.lit(3)).alias("a"),
        strings.substr(s, F.lit(0), F.lit(2)).alias("b"),
        strings.substr(s, F.lit(-2), F.lit(5)).alias("c"),
        strings.substr(s, F.lit(3)).alias("d"),
        strings.substr(s, F.lit(-5), F.lit(2)).alias("e"),
    )


@frame("str_left_right", "SELECT p_partkey, left(p_name, 3) AS a, left(p_name, -3) AS b, right(p_name, 2) AS c, right(p_name, -2) AS d FROM part")
def _(t):
    s = F.col("p_name")
    return t("part").select("p_partkey", strings.left(s, F.lit(3)).alias("a"), strings.left(s, F.lit(-3)).alias("b"), strings.right(s, F.lit(2)).alias("c"), strings.right(s, F.lit(-2)).alias("d"))


@frame("str_concat_nulls", "SELECT o_orderkey, concat(NULLIF(o_orderstatus, 'F'), '/', o_orderpriority) AS c FROM orders")
def _(t):
    return t("orders").select("o_orderkey", strings.concat(F.nullif("o_orderstatus", F.lit("F")), F.lit("/"), F.col("o_orderpriority")).alias("c"))


@frame("str_case", "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l FROM customer")
def _(t):
    return t("customer").select("c_custkey", strings.upper_ascii(F.col("c_mktsegment")).alias("u"), strings.lower_ascii(F.col("c_name")).alias("l"))


@frame("str_char_lengths", "SELECT l_orderkey, l_linenumber, CAST(length(l_returnflag) AS INT) AS n, CAST(10 AS INT) AS b FROM lineitem")
def _(t):
    c = strings.char_pad(F.col("l_returnflag"), 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.char_length(strings.char_key(c)).alias("n"), F.octet_length(c).alias("b"))


@frame("str_regexp_replace", r"SELECT page_id, regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS host, regexp_replace(url, '([a-z]+)', '<\1>') AS first FROM pages")
def _(t):
    u = F.col("url")
    return t("pages").select("page_id", strings.regexp_replace_first(u, r"^https?://(?:www\.)?([^/]+)/.*$", r"\1").alias("host"), strings.regexp_replace_first(u, "([a-z]+)", r"<\1>").alias("first"))


@frame("date_extract", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders")
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", *[dates.extract(f, d).alias(f[0]) for f in ("year", "quarter", "month", "day")])


@frame("ts_extract", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, month(ts) AS mo FROM events")
def _(t):
    ts = F.col("ts")
    return t("events").select("event_id", dates.extract("hour", ts).alias("h"), dates.extract("minute", ts).alias("m"), dates.extract("month", ts).alias("mo"))


@frame("date_add_days", "SELECT o_orderkey, CAST(@odate + CAST(o_custkey % 30 AS INT) AS DATE) AS a, CAST(@odate - 7 AS DATE) AS b FROM orders")
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", dates.add_days(d, (F.col("o_custkey") % 30).cast("int")).alias("a"), dates.add_days(d, -7).alias("b"))


sql("date_interval_fold", "SELECT count(*) AS n FROM orders WHERE @odate < DATE '1996-01-31' + INTERVAL '1' MONTH")
sql("date_group", "SELECT @odate AS d, count(*) AS n FROM orders GROUP BY @odate")


#: Words in three ways of writing, and what the locale sorts them by: letters first, then small before capital ones.
_WORDS = "(SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN upper(x) WHEN 1 THEN x ELSE concat(upper(left(x, 1)), substr(x, 2)) END AS w FROM (SELECT p_partkey, p_brand, regexp_replace(lower(p_name), '[^a-z].*', '') AS x FROM part) t) u"
_WEIGHT = "lower(w) || ' ' || regexp_replace(regexp_replace(w, '[a-z]', '0', 'g'), '[A-Z]', '1', 'g')"


def _words(t):
    x = F.regexp_replace(F.lower("p_name"), "[^a-z].*", "")
    w = F.when(F.col("p_partkey") % 3 == 0, F.upper(x)).when(F.col("p_partkey") % 3 == 1, x).otherwise(F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))
    return t("part").select("p_partkey", "p_brand", w.alias("w"))


@frame("agg_minmax_locale", f"SELECT p_brand, arg_min(w, {_WEIGHT}) AS lo, arg_max(w, {_WEIGHT}) AS hi FROM {_WORDS} GROUP BY p_brand")
def _(t):
    return _words(t).groupBy("p_brand").agg(strings.min_locale(F.col("w")).alias("lo"), strings.max_locale(F.col("w")).alias("hi"))


@frame("str_compare_locale", f"SELECT p_partkey, CASE WHEN {_WEIGHT} < 'blue 1000' THEN -1 WHEN {_WEIGHT} > 'blue 1000' THEN 1 ELSE 0 END AS c FROM {_WORDS}")
def _(t):
    return _words(t).select("p_partkey", strings.compare_locale(F.col("w"), F.lit("Blue")).alias("c"))


@frame("sort_text_locale", f"SELECT w, p_partkey FROM {_WORDS} ORDER BY {_WEIGHT}, p_partkey")
def _(t):
    return _words(t).select("w", "p_partkey").orderBy(F.collate("w", "UNICODE"), "p_partkey")


@frame("str_case_locale", "SELECT doc_id, replace(upper(text), chr(7838), 'ß') AS u, lower(text) AS l FROM documents")
def _(t):
    return t("documents").select("doc_id", strings.upper_single(F.col("text")).alias("u"), strings.lower_single(F.col("text")).alias("l"))


sql("cast_decimal_double", "SELECT o_orderkey, CAST(@total AS DOUBLE) AS d FROM orders")
sql("cast_relabel", "SELECT c_custkey, CAST(CAST(c_name AS VARCHAR(40)) AS [[STRING||VARCHAR]]) || '' AS n, CAST(CAST(@cbal AS DECIMAL(20,2)) AS DECIMAL(25,2)) AS b FROM customer")
