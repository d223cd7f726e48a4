import os

import duckdb
import pytest

from nestwell.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF)] if os.path.isdir(SF) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = catalogue.oracle_sql()[name]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_ranges_reach_the_scan(spark):
    plan = catalogue.queries()["typed_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "o_orderpriority" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())
