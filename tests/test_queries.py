"""Every query of the core against its SQL on the same tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from millrace.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if isinstance(v, Decimal) else v


def _rows(rows):
    return sorted(([_value(v) for v in r] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = duck.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert _rows(df.select(*cols).collect()) == _rows([[x[i] for i in at] for x in r.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert catalogue.entry(spark, data).count() > 0
