"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import digest, type_differences
from loomgraph.plans.tables import NAMES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    if not name.startswith("op") and name != "pipeline":  # no plan pairs all rows or leaves the JVM row by row
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))
    got = digest(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1] > 0
        return
    cur = db.execute(sql)
    types = type_differences(df, cur.description)
    want = digest([d[0] for d in cur.description], cur.fetchall())
    assert got[:3] == want[:3] and not types


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "dst"]
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
