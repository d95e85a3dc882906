"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from voxelspark.plans import queries_graphs, queries_voxels

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = queries_voxels.Q | queries_graphs.Q, queries_voxels.SQL | queries_graphs.SQL

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(SQL[name])
    named = [c[0] for c in cur.description]
    assert sorted(named) == columns
    want = sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-4)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Rows of the columns that the query names; their values are held against models in test_values and test_cases."""
    df = QUERIES[name](spark, str(DATA))
    found = df.collect()
    assert found and all(r[c] is not None for r in found[:50] for c in df.columns if c not in ("merge_score", "parent", "score"))
