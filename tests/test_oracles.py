"""Every query of the library's own operators against its DuckDB SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from scopeloom.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Queries that SQL can't say; their own tests are in test_operators.py.
BEYOND_SQL = {"cosine_topk_ann"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def test_all_have_an_oracle():
    assert QUERIES.keys() - ORACLES.keys() == BEYOND_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(BEYOND_SQL))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    found = df.collect()
    assert len(df.columns) == len(set(df.columns)) and found
    assert all(v is not None for r in found for v in r)
