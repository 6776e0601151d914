import os

import pytest

import __spark_entry__ as entry
from heddle.plans import queries as plans

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def alike(x):
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x


@needs_data
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_statement(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    rel = duck.sql(plans.SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    rows = lambda it: sorted((tuple(alike(x) for x in r) for r in it), key=str)
    assert rows(df.select(*cols).collect()) == rows(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
