import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        return round(float(x), 6) if isinstance(x, (int, float)) else None if x is None else str(x)

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns, data = [d[0] for d in want.description], want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, data)


def test_every_engine_query_has_sql_and_entry_runs(spark):
    assert set(entry.engine.QUERIES) == set(entry.engine.ORACLE_SQL)
    assert entry.entry(spark).count() > 0
