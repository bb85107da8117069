"""Every query of the library against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from marlstone import plans

DATA = os.environ.get("MARLSTONE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v + 0.0, 6))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    rows = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted([plain(r[c]) for c in order] for r in rows)
    other = sorted([plain(r[columns.index(c)]) for c in order] for r in got.fetchall())
    assert mine == other
