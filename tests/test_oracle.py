"""Every query with a statement in SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from tripletide.plans import queries as core

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, query, sql):
    con = duckdb.connect()
    for p in glob.glob(SMALL + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, SMALL)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert mine == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, name):
    compare(spark, core.queries()[name], core.oracle_sql()[name])
