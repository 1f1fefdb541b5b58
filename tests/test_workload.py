"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from plumbline import workload

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")



@pytest.fixture(scope="module")
def tables():
    from plumbline.plans.derived import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query_equals_sql(spark, tables, name):
    df = workload.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((str(tuple(map(canonical, r))) for r in df.select(*columns).collect()))
    result = tables.execute(workload.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(str(tuple(canonical(r[i]) for i in order)) for r in result.fetchall())
    assert got and got == want


def test_every_query_has_a_check():
    assert set(workload.queries()) == set(workload.oracle_sql())
