"""Queries that must see every row, counted from the tables by plain Python.

At sf0.01, since some cuts by id or by LIMIT are wider than the smallest tables.
"""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from quern.plans import catalog

QUERIES = catalog.queries()
WHOLE = "/root/testdata/sf0.01"


def column(table, name):
    return pq.read_table(f"{WHOLE}/{table}.parquet", columns=[name])[name].to_pylist()


def left_keys():
    return {i: None if i % 7 == 0 else c % 400 for i, c in zip(column("orders", "o_orderkey"), column("orders", "o_custkey"), strict=True)}


def right_keys():
    return {j: None if j % 5 == 0 else j % 300 + 150 for j in column("customer", "c_custkey")}


@pytest.mark.parametrize(("name", "a", "b"), [("join_left", True, False), ("join_left_filter_on", True, False), ("join_right", False, True), ("join_full", True, True)])
def test_outer_joins_keep_every_row(spark, name, a, b):
    rows = QUERIES[name](spark, WHOLE).select("i", "j").collect()
    left, right = left_keys(), right_keys()
    on = {"join_left_filter_on": lambda i, j: i > 500 and j < 300, "join_right": lambda i, j: j % 2 == 0}.get(name, lambda i, j: True)
    by_key = {}
    for j, k in right.items():
        by_key.setdefault(k, []).append(j)
    pairs = {(i, j) for i, k in left.items() if k is not None for j in by_key.get(k, []) if on(i, j)}
    want = Counter(pairs)
    want += Counter((i, None) for i in left.keys() - {i for i, _ in pairs}) if a else Counter()
    want += Counter((None, j) for j in right.keys() - {j for _, j in pairs}) if b else Counter()
    assert Counter(map(tuple, rows)) == want


def test_null_equal_join_counts_all_pairs(spark):
    left, right = Counter(left_keys().values()), Counter(right_keys().values())
    pairs = sum(n * right[k] for k, n in left.items())
    assert tuple(QUERIES["join_null_equal"](spark, WHOLE).first()) == (pairs, pairs - left[None] * right[None])


def test_float_keys_of_all_lines(spark):
    nan = "nan"
    lines = Counter(nan if n == 1 else 0.0 if n == 2 else q for n, q in zip(column("lineitem", "l_linenumber"), column("lineitem", "l_quantity"), strict=True))
    nations = Counter(nan if n == 0 else n - 1.0 for n in column("nation", "n_nationkey"))
    assert QUERIES["join_float_key"](spark, WHOLE).first()[0] == sum(n * nations[k] for k, n in lines.items())


def test_multiset_operations_see_all_rows(spark):
    got = {name: Counter(r[0] for r in QUERIES[name](spark, WHOLE).collect()) for name in ("set_intersect_all", "set_except_all")}
    priority, status = column("orders", "o_orderpriority"), column("orders", "o_orderstatus")
    assert got["set_intersect_all"] == Counter(status) & Counter(column("lineitem", "l_linestatus"))
    assert got["set_except_all"] == Counter(priority) - Counter(p for p, s in zip(priority, status, strict=True) if s == "F")


def test_insert_select_takes_all_orders(spark):
    orders = Counter(zip(column("orders", "o_orderkey"), column("orders", "o_orderstatus"), strict=True))
    got = Counter(map(tuple, QUERIES["sink_insert_select"](spark, WHOLE).collect()))
    assert got == orders + Counter({x: n for x, n in orders.items() if x[1] == "F"})


@pytest.mark.parametrize(("name", "gone", "order"), [("sort_nulls", 3, lambda k: (k is None, k or 0)), ("sort_desc_nulls_first", 3, lambda k: (k is not None, -(k or 0))), ("sort_desc_nulls_last", 6, lambda k: (k is None, -(k or 0)))])
def test_sorts_return_the_whole_table_in_order(spark, name, gone, order):
    keys = [None if c % 7 == gone else c % 7 for c in column("orders", "o_custkey")]
    want = sorted(zip(keys, column("orders", "o_orderkey"), strict=True), key=lambda r: (order(r[0]), r[1]))
    assert [tuple(r) for r in QUERIES[name](spark, WHOLE).collect()] == want


def test_text_sort_returns_the_whole_table_in_order(spark):
    rows = list(zip(column("customer", "c_mktsegment"), column("customer", "c_name"), column("customer", "c_custkey"), strict=True))
    rows.sort(key=lambda r: r[2])
    rows.sort(key=lambda r: r[1].encode(), reverse=True)
    rows.sort(key=lambda r: r[0].encode())
    assert [tuple(r) for r in QUERIES["sort_text_bytes"](spark, WHOLE).collect()] == [r[1:] for r in rows]
