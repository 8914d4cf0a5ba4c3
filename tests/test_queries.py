"""Every registered query against its SQL twin on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from lectern.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_twin(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((repr([norm(r[c]) for c in order]) for r in rows))
    want = sorted(repr([norm(r[columns.index(c)]) for c in order]) for r in cursor.fetchall())
    assert got == want
