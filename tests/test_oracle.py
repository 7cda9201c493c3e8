"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from marketlake import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0 if v else 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(norm, v)) if isinstance(v, list) else v


def close(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-4 * max(1.0, abs(x))) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(registry.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    order = lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=order)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=order)
    assert len(got) == len(want) and all(map(close, got, want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
