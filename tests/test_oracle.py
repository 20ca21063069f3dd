"""Every query outside the llm subpackage against its SQL on the smallest data."""

import collections
import glob
import os

import pytest

import loomtab.plans as plans

duckdb = pytest.importorskip("duckdb")
QUERIES, SQL = plans.all_queries(), plans.all_oracles()


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = db.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_every_query_has_sql_or_is_tested_otherwise():
    assert {n for n in QUERIES if n not in SQL and not n.startswith("p")} == set()
