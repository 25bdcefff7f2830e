"""Extents and lookups over more than 500 runs, against plain versions."""

from __future__ import annotations

import random

import pytest

from arbordex.operators import extents
from arbordex.plans.queries import REGISTRY

PARTS = [(k, k * 7 % 50 + 1) for k in range(1, 901)]


def plain_extents():
    found, vcn = [], 0
    for seq, size in PARTS:
        if seq % 7:
            found.append((seq, seq * 1000, size, vcn, vcn * 4, (vcn + size) * 4 - 1))
        vcn += size
    return found


def plain_offset(record):
    for _, lcn, n, vcn, _, _ in plain_extents():
        if vcn <= record // 4 < vcn + n:
            return (lcn + record // 4 - vcn) * 4096 + record % 4 * 1024
    return 786432 * 4096 + record * 1024


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("parts")
    spark.createDataFrame(PARTS, "p_partkey long, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(k * 13, k % 5 + 1) for k in range(1100)], "l_orderkey long, l_linenumber int").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_all_extents(spark, folder):
    f, _ = REGISTRY["ag10_extents"]
    assert sorted(tuple(r) for r in f(spark, folder).collect()) == plain_extents()


def test_all_lookups(spark, folder):
    f, _ = REGISTRY["jn09_extent_lookup"]
    records = [k * 13 * 7 + k % 5 + 1 for k in range(1100)]
    got = sorted(tuple(r) for r in f(spark, folder).collect())
    assert got == sorted((r, plain_offset(r)) for r in records)
    last = max(e[5] for e in plain_extents() if e[0] <= 500)
    assert any(r > last and o != 786432 * 4096 + r * 1024 for r, o in got)


def test_lookups_either_way(spark):
    rows = spark.createDataFrame([("R", r) for r in range(0, 70_000, 31)], "drive string, record_number long")
    runs = spark.createDataFrame([("R", k, k * 1000, n, k % 7 == 0) for k, n in PARTS], "drive string, seq long, lcn long, clusters long, sparse boolean")
    ways = [extents.record_offsets(rows, extents.extent_map(runs), 786432, 4096, 1024, small).collect() for small in (True, False)]
    assert sorted(ways[0]) == sorted(ways[1])


def test_held_makes_no_pairs(spark):
    """tr02_inspect: overlapping, empty and long extents over several stretches, two drives; as a plain loop has it, without a join by range."""
    r = random.Random(3)
    spans = [(d, s, n) for d in "CD" for s, n in [(0, 3), (5, 0), (7, 400_000), (9, 2), (500_000, 1), (900_000, 300_000), *((r.randrange(2_000_000), r.randrange(2_000)) for _ in range(60))] if d == "C" or s % 2]
    points = [(d, p) for d in "CDE" for p in [0, 2, 3, 5, 6, 400_006, 400_007, 500_000, 500_001, *(r.randrange(2_100_000) for _ in range(300))]]
    e = spark.createDataFrame(spans, "drive string, vcn long, clusters long")
    found = extents.held(spark.createDataFrame(points, "drive string, vcn long"), e)
    assert {tuple(x) for x in found.collect()} == {(d, p) for d, p in points if any(d == x and s <= p < s + n for x, s, n in spans)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not [x for x in plan.split("\n") if "Join" in x and (" < " in x or " >= " in x)]
