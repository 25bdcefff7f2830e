"""The whole sort by path, in order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from arbordex.plans.queries import REGISTRY

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")
def test_all_rows_are_sorted(spark):
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    f, sql = REGISTRY["so01_sort_path"]
    got, want = [tuple(r) for r in f(spark, str(SF)).collect()], c.sql(sql).fetchall()
    assert len(got) > 200 and got == want
