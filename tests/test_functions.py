"""Edge grids of the semantic layer, with the expected values spelt out."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.functions import dates, numeric, strings
from quern.operators import control, grouping, order, skew, subquery


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("start", "length", "want"),
    [(0, 2, "h"), (-2, 3, ""), (-2, 4, "h"), (2, 3, "ell"), (1, 0, ""), (3, 100, "llo"), (-5, 2, ""), (2**31 - 1, 2**31 - 1, ""), (1, 2**31 - 1, "hello")],
)
def test_substr_window(spark, start, length, want):
    assert one(spark, strings.substr(F.lit("hello"), F.lit(start), F.lit(length))) == want


def test_substr_negative_length_is_an_error(spark):
    with pytest.raises(Exception, match="22011"):
        one(spark, strings.substr(F.lit("hello"), F.lit(1), F.lit(-1)))


@pytest.mark.parametrize(("n", "left", "right"), [(2, "he", "lo"), (-2, "hel", "llo"), (0, "", ""), (-9, "", ""), (9, "hello", "hello")])
def test_left_right(spark, n, left, right):
    assert one(spark, strings.left(F.lit("hello"), F.lit(n))) == left
    assert one(spark, strings.right(F.lit("hello"), F.lit(n))) == right


def test_right_of_smallest_int(spark):
    assert one(spark, strings.right(F.lit("héllo"), F.lit(-(2**31)))) == ""


def test_case_maps_keep_length(spark):
    assert one(spark, strings.upper_single(F.lit("straße é"))) == "STRAßE É"
    assert one(spark, strings.upper_ascii(F.lit("aé"))) == "Aé"


@pytest.mark.parametrize(("text", "want"), [("a1b2", "a<1>b2"), ("none", "none"), ("", ""), ("7\n8", "<7>\n8")])
def test_regexp_replaces_first_match(spark, text, want):
    assert one(spark, strings.regexp_replace_first(F.lit(text), r"(\d)", r"<\1>")) == want


def test_regexp_whole_match_and_dollar(spark):
    assert one(spark, strings.regexp_replace_first(F.lit("price 5"), r"\d", r"$\&")) == "price $5"


def test_concat_skips_nulls(spark):
    assert one(spark, strings.concat(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "ab"


@pytest.mark.parametrize(("x", "want"), [(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (-1.5, -2)])
def test_float_to_int_half_even(spark, x, want):
    assert one(spark, numeric.float_to_int(F.lit(x))) == want


@pytest.mark.parametrize(("x", "want"), [("0.5", 1), ("1.5", 2), ("2.5", 3), ("-0.5", -1), ("-2.4", -2)])
def test_decimal_to_int_half_away(spark, x, want):
    assert one(spark, numeric.decimal_to_int(F.lit(x).cast("decimal(9,2)"))) == want


@pytest.mark.parametrize(("a", "b", "q"), [(7, 2, 3), (-7, 2, -3), (7, -2, -3)])
def test_integer_division_truncates(spark, a, b, q):
    assert one(spark, numeric.div_int(F.lit(a), F.lit(b))) == q


def test_division_by_zero_is_an_error(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, numeric.div_int(F.lit(1), F.lit(0)))


def test_float_overflow_is_an_error(spark):
    big = spark.createDataFrame([(1e308, 10.0)], "a double, b double")
    with pytest.raises(Exception, match="22003"):
        big.select(numeric.float_checked(F.col("a") * F.col("b"), F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="22003"):
        big.select(numeric.double_to_float(F.col("a"))).collect()


def test_exact_aggregates(spark):
    df = spark.createDataFrame([(9223372036854775807,), (9223372036854775807,), (None,)], "x long")
    assert df.agg(numeric.sum_exact(F.col("x")).alias("s")).first()["s"] == Decimal(2 * 9223372036854775807)
    third = spark.createDataFrame([(1,), (0,), (0,)], "x int").agg(numeric.avg_exact(F.col("x")).alias("a")).first()["a"]
    assert third == Decimal("0.3333333333333333")
    empty = spark.createDataFrame([], "x int").agg(numeric.avg_exact(F.col("x")).alias("a"), numeric.variance_exact(F.col("x"), False).alias("v")).first()
    assert empty["a"] is None and empty["v"] is None


def test_extract_rejects_other_fields():
    with pytest.raises(ValueError, match="second"):
        dates.extract("second", F.lit(1))


def test_assert_passes_null(spark):
    df = spark.createDataFrame([(None, "a"), (True, "b")], "ok boolean, v string")
    assert [r[0] for r in df.select(control.assert_true(F.col("ok"), "no", F.col("v"))).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="P0003"):
        spark.range(1).select(control.assert_true(F.lit(False), "no", F.lit("x"))).collect()


@pytest.mark.parametrize(("values", "want"), [([1, None], [True, None, None]), ([1, 2], [True, False, None]), ([], [False, False, False])])
def test_in_set_is_three_valued(spark, values, want):
    df = spark.createDataFrame([(0, 1), (1, 5), (2, None)], "i int, x int")
    found = subquery.in_set(df, F.col("x"), spark.createDataFrame([(v,) for v in values], "m int"), "v")
    assert [r["v"] for r in found.orderBy("i").collect()] == want


def test_scalar_of_more_than_one_row(spark):
    with pytest.raises(Exception, match="21000"):
        subquery.scalar_of(spark.range(1), spark.range(2).select(F.col("id").alias("m")), "v").collect()


@pytest.mark.parametrize(("values", "want"), [([5], [1]), ([5, None], []), ([], [1, 5, None])])
def test_null_aware_anti(spark, values, want):
    df = spark.createDataFrame([(1,), (5,), (None,)], "k int")
    found = subquery.null_aware_anti(df, "k", spark.createDataFrame([(v,) for v in values], "m int"))
    assert sorted((r["k"] for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_empty_grouping_set_over_no_rows(spark):
    df = spark.createDataFrame([], "k int, v int")
    rows = grouping.grouping_sets(df, ["k"], [["k"], [], []], [F.count(F.lit(1)).alias("n")], group_id="g").collect()
    assert sorted((r["k"], r["n"], r["g"]) for r in rows) == [(None, 0, 0), (None, 0, 1)]


def test_salted_join_equals_plain(spark):
    left = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(repr, skew.salted_join(left, right, ["k"], 4, how).collect())) == sorted(map(repr, left.join(right, "k", how).collect()))
    with pytest.raises(ValueError, match="full"):
        skew.salted_join(left, right, ["k"], 4, "full")


def test_top_k_plan_keeps_no_full_sort(spark, data):
    df = spark.read.parquet(f"{data}/orders.parquet")
    plan = order.top_k(df, [order.desc("o_totalprice")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    from quern.plans import catalog

    plan = catalog.queries()["scan_like_pushdown"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,blue)" in plan and "p_retailprice" not in plan


@pytest.mark.parametrize("pattern", [r"^a?(?:ab)?(.*)$", r"(a)\1", "a+?b", "((a)b)", "a*ab", "(ab)?(abcd)?", "(?:a*b?)+c", "ab|c"])
def test_patterns_with_several_matches_are_refused(pattern):
    with pytest.raises(ValueError, match="several ways"):
        strings.checked_pattern(pattern)


@pytest.mark.parametrize(("text", "pattern", "replacement", "want"), [("xaab", "(a)a", r"<\1>", "x<a>b"), ("aab\n", "^(a*)b.*$", r"\1", "aa"), ("a$b", r"(\$)b", r"[\1]$", "a[$]$"), ("https://www.x.org/p", r"^https?://(?:www\.)?([^/]+)/.*$", r"\1", "x.org")])
def test_first_match_is_replaced(spark, text, pattern, replacement, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(strings.regexp_replace_first(F.col("s"), pattern, replacement)).first()[0] == want


def test_float_overflow_is_an_error(spark):
    df = spark.createDataFrame([(1, 1.5e308), (1, 1.5e308), (2, float("inf")), (2, 1.0), (3, None)], "k int, x double")
    got = {r["k"]: r["s"] for r in df.where("k > 1").groupBy("k").agg(numeric.sum_float(F.col("x")).alias("s")).collect()}
    assert got == {2: float("inf"), 3: None}
    with pytest.raises(Exception, match="22003"):
        df.groupBy("k").agg(numeric.sum_float(F.col("x"))).collect()
    with pytest.raises(Exception, match="22003"):
        df.select(numeric.float_checked(F.col("x") * 10, F.col("x"))).collect()


def test_quotients_are_exact(spark):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    rows = [(Decimal("99999999999999999.99"), Decimal("3.00")), (Decimal("-0.01"), Decimal("7.00")), (Decimal("1.00"), Decimal("-64.00")), (Decimal("123456789012345.67"), Decimal("0.07")), (None, Decimal("1.00"))]
    df = spark.createDataFrame(rows, "a decimal(19,2), b decimal(5,2)")
    got = [r[0] for r in df.select(numeric.divide_decimal(F.col("a"), F.col("b"))).collect()]
    with localcontext() as c:
        c.prec = 60
        assert got == [None if a is None else (a / b).quantize(Decimal(1).scaleb(-16), ROUND_HALF_UP) for a, b in rows]
        mean = df.agg(numeric.avg_exact(F.col("a"))).first()[0]
        known = [a for a, _ in rows if a is not None]
        assert mean == (sum(known) / len(known)).quantize(Decimal(1).scaleb(-16), ROUND_HALF_UP)
    with pytest.raises(Exception, match="22012"):
        df.select(numeric.divide_decimal(F.col("a"), F.col("b") - F.col("b"))).collect()


def test_running_sums_and_ranks_over_ranges(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "p string, k int, i int").repartition(5)
    got = {r["i"]: r for r in order.with_running(df, ["p"], [order.asc("k"), order.asc("i")], sums={"s": F.sum("i")}, row_number="n").collect()}
    tied = {r["i"]: r for r in order.with_running(df, ["p"], [order.desc("k")], rank="r", dense="d").collect()}
    assert len(got) == len(tied) == 500
    for p in ("a", "b", None):
        own = sorted([x for x in rows if x[0] == p], key=lambda x: (x[1] is None, x[1] or 0, x[2]))
        total = 0
        for n, (_, k, i) in enumerate(own, 1):
            total += i
            assert (got[i]["s"], got[i]["n"]) == (total, n)
            above = [x[1] for x in own if x[1] != k and (x[1] is None or (k is not None and x[1] > k))]
            assert (tied[i]["r"], tied[i]["d"]) == (1 + len(above), 1 + len(set(above)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan_and_the_folders(spark, data, tmp_path):
    from quern.sources.tables import create_partitioned, table

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    scan = plan(table(spark, data, "lineitem").where("l_orderkey BETWEEN 100 AND 900 AND l_quantity < 24").select("l_linenumber"))
    assert "GreaterThanOrEqual(l_orderkey,100)" in scan and "LessThan(l_quantity,24.0)" in scan and "l_comment" not in scan
    orders = table(spark, data, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    whole = create_partitioned(orders, str(tmp_path / "t"), ["y"])
    some = whole.where("y = 1997")
    assert "PartitionFilters: [isnotnull(y" in plan(some) and "(y" in plan(some)
    assert some.inputFiles() != whole.inputFiles() or len(whole.inputFiles()) >= 1
    assert some.count() == orders.where("y = 1997").count()


@pytest.mark.parametrize("name", ["tpch_q2", "tpch_q17", "tpch_q20"])
def test_key_filters_stand_below_the_aggregate(spark, data, name):
    """lineitem is read once, and the parts that are asked for reach it before anything is aggregated."""
    from quern.plans import catalog

    lines = catalog.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("l_orderkey" in x and "Relation" in x for x in lines) == 1
    semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x and "l_partkey" in x)
    grouped = next(i for i, x in enumerate(lines) if ("Aggregate" in x or "Window" in x) and "l_partkey" in x)
    assert grouped < semi


@pytest.mark.parametrize("name", ["gs_cube", "cte_shared_scan"])
def test_shared_inputs_are_computed_once(spark, data, name):
    from quern.plans import catalog

    df = catalog.queries()[name](spark, data)
    df.collect()
    assert "ReusedExchange" in plan(df)
    assert name != "gs_cube" or plan(df).split("== Initial Plan ==")[0].count("FileScan") == 1


def test_rows_per_node(spark, data):
    from quern.operators.diagnostics import in_engine, node_rows
    from quern.sources.tables import table

    orders = table(spark, data, "orders")
    df = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    nodes = node_rows(df)
    statuses = orders.select("o_orderstatus").distinct().count()
    assert next(n for _, name, n in nodes if "HashAggregate" in name) == statuses
    assert next(n for _, name, n in nodes if "Scan" in name) == orders.count()
    assert in_engine(df) and not in_engine(df.mapInArrow(lambda b: b, df.schema))
