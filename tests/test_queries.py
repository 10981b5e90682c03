"""Every registered general query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillon import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null" if v is None else "nan"
    if isinstance(v, float):
        return f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name in SQL:
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == cols
        theirs = sorted(tuple(_plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
        assert mine == theirs
    else:
        assert mine
