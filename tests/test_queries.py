"""Every registered query against its oracle SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quern.plans import catalog
from quern.sources.tables import TABLES

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return con


def _rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, oracle):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = oracle.sql(ORACLE[name])
    assert sorted(found.columns) == columns
    assert _rows(df.select(*columns).collect()) == _rows(found.select(",".join(f'"{c}"' for c in columns)).fetchall())
