"""Each query with SQL gives what DuckDB gives over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from arbordex.plans.queries import REGISTRY

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_matches_sql(spark, duck, name):
    f, sql = REGISTRY[name]
    df = f(spark, str(SF))
    want = duck.sql(sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
