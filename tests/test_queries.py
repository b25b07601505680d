"""Each registered market query against its oracle on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

from tideframe.plans import market_queries as Q
from tideframe.plans import stored_queries  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are elsewhere")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def value(x):
    return str(x.normalize()) if isinstance(x, decimal.Decimal) else str(x)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, str(DATA))
    result = duck.execute(Q.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(value(r[names.index(c)]) for c in df.columns) for r in result.fetchall())
    assert sorted(tuple(map(value, r)) for r in df.collect()) == want


def test_the_rest_runs(spark):
    for name in sorted(set(Q.QUERIES) - set(Q.SQL)):
        assert Q.QUERIES[name](spark, str(DATA)).count() > 0
