"""Each query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from fleetlens.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool | str):
        return str(x)
    try:
        return f"{float(x) + 0.0:.6f}"
    except (TypeError, ValueError):
        return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in values])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_query_runs(spark, data):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, data).count() > 0, name
