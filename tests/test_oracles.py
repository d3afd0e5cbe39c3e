"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from trendloom.plans import audits, comparing, discovery, filing, lifecycle  # noqa: F401  add their queries
from trendloom.plans.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return None if math.isnan(value) else round(float(value), 5)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([repr(plain(r[i])) for i in order] for r in rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
