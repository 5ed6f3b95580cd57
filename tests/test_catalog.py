"""Every query with SQL equals it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    r = con.execute(SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(str([norm(row[cols.index(c)]) for c in sorted(cols)]) for row in r.fetchall())
    assert sorted(str([norm(row[c]) for c in sorted(cols)]) for row in got) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["question_id", "company", "id", "score", "rank"]
