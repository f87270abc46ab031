"""How a query and its oracle are registered side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import TABLES, register, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Shorthands for exact money columns; the data has two decimals, so the casts lose nothing.
MACROS = {
    "@price": "CAST(l_extendedprice AS DECIMAL(15,2))",
    "@disc": "CAST(l_discount AS DECIMAL(4,2))",
    "@tax": "CAST(l_tax AS DECIMAL(4,2))",
    "@qty": "CAST(l_quantity AS DECIMAL(15,2))",
    "@total": "CAST(o_totalprice AS DECIMAL(15,2))",
    "@rev": "(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2)))",
    "@cbal": "CAST(c_acctbal AS DECIMAL(15,2))",
    "@sbal": "CAST(s_acctbal AS DECIMAL(15,2))",
    "@ship": "CAST(l_shipdate AS DATE)",
    "@odate": "CAST(o_orderdate AS DATE)",
}


def expand(text: str, spark: bool) -> str:
    """Fill in the macros and choose a dialect: ``[[spark||duckdb]]``."""
    for name, value in MACROS.items():
        text = text.replace(name, value)
    return re.sub(r"\[\[(.*?)\|\|(.*?)\]\]", lambda m: m[1] if spark else m[2], text, flags=re.S)


def quotient(dividend: str, divisor: str, scale: int) -> str:
    """Oracle text of an exact quotient of integers as DECIMAL(38, scale), half away from zero, from integer division alone."""
    a, b = f"CAST({dividend} AS HUGEINT)", f"CAST({divisor} AS HUGEINT)"
    units = f"((abs({a}) * CAST('1{'0' * scale}' AS HUGEINT) * 2 + abs({b})) // (2 * abs({b})))"
    shown = f"lpad(CAST({units} AS VARCHAR), CAST(greatest(length(CAST({units} AS VARCHAR)), {scale + 1}) AS INT), '0')"
    digits = f"concat(CASE WHEN ({a} < 0) <> ({b} < 0) THEN '-' ELSE '' END, left({shown}, length({shown}) - {scale}), '.', right({shown}, {scale}))"
    return f"CAST({digits} AS DECIMAL(38,{scale}))"


def sql(name: str, text: str) -> None:
    """A query that both engines run from one text."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, used)
        return spark.sql(expand(text, True))

    QUERIES[name] = run
    ORACLE[name] = expand(text, False)


def frame(name: str, oracle: str | None):
    """Register a DataFrame function, called with a loader of tables, and its oracle."""

    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda t: table(spark, sf_dir, t))

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = expand(oracle, False)
        return build

    return wrap
