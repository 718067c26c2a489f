"""Every core query with SQL against that SQL, on the smallest tables; the rest must run."""

import os

import duckdb
import pytest

from spanlode import core_problems, queries, sql

ROOT = "/root/testdata/sf0.001"
ALL = queries.QUERIES | core_problems.QUERIES
ORACLE = sql.SQL | core_problems.SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(ROOT):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{ROOT}/{t}')")
    return con


def plain(x):
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x.replace(tzinfo=None)) if hasattr(x, "tzinfo") else str(x)


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, db, name):
    df = ALL[name](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in ORACLE:
        return
    want = db.sql(ORACLE[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
