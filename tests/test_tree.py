from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbordex.operators import extents, merge, sinks, tree, treemap
from arbordex.schema import NODES
from arbordex.sources import volumes


def nodes_of(spark, rows):
    """rows: (record, parent, name, size, directory)."""
    return spark.createDataFrame([("C", r, p, r, n, s, s, 16 if d else 32, d, 0, 0, "mft") for r, p, n, s, d in rows], NODES)


def forest(seed):
    rng = random.Random(seed)
    rows, dirs = [(5, 5, ".", 0, True)], [5]
    for r in range(10, 60):
        rows.append((r, rng.choice([*dirs[-6:], 5, 999]), f"d{r}", 0, True))
        dirs.append(r)
    rows += [(80, 81, "p", 0, True), (81, 82, "q", 0, True), (82, 80, "s", 0, True), (83, 82, "under", 0, True), (84, 84, "self", 0, True), (85, 0, "z", 0, True)]
    for r in range(100, 300):
        rows.append((r, rng.choice([*dirs, 80, 83, 85, 777]), rng.choice(["A.txt", "a.TXT", f"f{r}"]), rng.randrange(100), False))
    return rows


def naive(rows):
    """record -> (state, names from the record up) of directories."""
    by = {r: (p, n) for r, p, n, _, d in rows if d}
    out = {}
    for r in by:
        at, seen, names = r, [], []
        while at in by and at not in seen and at != 5:
            seen.append(at)
            names.append(by[at][1])
            at = by[at][0]
        out[r] = ("root" if at == 5 else "cycle" if at in seen else "missing", names)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_paths_and_sums(spark, seed):
    rows = forest(seed)
    nodes = tree.dedup(nodes_of(spark, rows))
    kept = {(r.record_number, r.parent_record_number): (r.name, r.file_size, r.is_directory) for r in nodes.collect()}
    least = {}
    for r, p, n, *_ in sorted(rows):
        least.setdefault((p, n.lower()), r)
    assert set(kept) == {(r, p) for r, p, n, *_ in rows if least[(p, n.lower())] == r}
    chains = tree.directory_chains(nodes)
    want = naive(rows)
    at = lambda names: "\\".join(["C:", *reversed(names)]) if names else "C:\\"
    assert {r.record: (r.state, r.path) for r in chains.collect()} == {r: (state, at(names)) for r, (state, names) in want.items()}
    sums = {}
    for (r, p), (_, size, is_dir) in kept.items():
        if r == p:
            continue
        at, seen = p, set()
        while at in want and want[at][0] == "root" and at not in seen:
            seen.add(at)
            s = sums.setdefault(at, [0, 0, 0])
            s[0] += size
            s[1] += not is_dir
            s[2] += is_dir
            at = 0 if at == 5 else next(q for (k, q) in kept if k == at)
    got = {r.record_number: [r.total_size, r.file_count, r.dir_count - 1] for r in tree.rollup(nodes, chains).where("is_directory").collect()}
    assert got == {r: sums.get(r, [0, 0, 0]) for r in got}
    lost = {r.record_number for r in tree.orphans(nodes).collect()}
    assert lost == {r for r, p in kept if p not in (0, 5) and p not in {k for k, _ in kept}}
    with_paths = {r.record_number: (r.path, r.path_complete) for r in tree.with_paths(nodes, chains).collect()}
    assert with_paths[5] == ("C:\\", True)
    for (r, p), (name, *_) in kept.items():
        if r != 5:
            state, names = want.get(p, ("missing", []))
            assert with_paths[r] == ("\\".join(["C:", *reversed(names), name]), state == "root")
    size = tree.tree_size(tree.rollup(nodes, chains), chains, 2, 3)
    assert size.where("depth = 0").count() == 1 and size.where("depth > 2").count() == 0


def test_deep_trees(spark):
    """A thousand levels: paths and totals are exact, a cycle of 300 directories and what hangs on it are cut."""
    rows = [(5, 5, ".", 0, True)] + [(10 + i, 5 if i == 0 else 9 + i, f"d{i}", 0, True) for i in range(1000)] + [(20_000 + i, 10 + i, f"f{i}", 7, False) for i in range(0, 1000, 9)]
    rows += [(50_000 + i, 50_000 + (i + 1) % 300, f"c{i}", 0, True) for i in range(300)] + [(60_000, 50_000, "tail", 0, True), (60_001, 60_000, "lost", 5, False)]
    nodes = tree.dedup(nodes_of(spark, rows))
    chains = tree.directory_chains(nodes)
    got = {r.record: r for r in chains.select("record", "path", "depth", "state").collect()}
    assert all(got[10 + i].state == "root" and got[10 + i].depth == i + 1 for i in range(1000))
    assert got[1009].path == "C:\\" + "\\".join(f"d{i}" for i in range(1000))
    assert {got[50_000 + i].state for i in range(300)} == {"cycle"} and got[60_000].state == "cycle" and got[60_000].depth == 301
    sums = {r.record_number: (r.total_size, r.file_count) for r in tree.rollup(nodes, chains).where("is_directory").collect()}
    assert sums[5] == (7 * 112, 112) and all(sums[10 + i] == (7 * (111 - (i + 8) // 9 + 1), 111 - (i + 8) // 9 + 1) for i in range(1000))
    assert {r.path_complete for r in tree.with_paths(nodes.where("record_number = 60001"), chains).collect()} == {False}


def test_results_and_counts(spark):
    rows = nodes_of(spark, [(5, 5, ".", 0, True), (10, 5, "a", 0, True), (11, 10, "x", 9, False), (12, 10, "y", 20, False)])
    top = tree.largest_directories(tree.rollup(rows), 5)
    assert [(r.record_number, r.file_size, r.total_size) for r in top.collect()] == [(5, 29, 29), (10, 29, 29)]
    one = merge.selection(rows, rows.where("file_size > 0")).head()
    assert (one.objects, one.selected, one.label) == (4, 2, " 4 objects | 2 selected | 29 B total")
    none = merge.selection(rows, rows.limit(0)).head(), merge.selection(rows.limit(0), rows, False).head()
    assert [(r.objects, r.selected) for r in none] == [(4, 1), (0, 0)]
    assert [tuple(r) for r in merge.counted(rows).collect()] == [("C", 4)] and merge.counted(rows.limit(0)).count() == 0


def test_an_opened_volume_follows_its_files(spark, tmp_path):
    """The stored volume is used again, until a source file is another one."""
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    nodes, chains = volumes.opened(spark, str(tmp_path))
    again, _ = volumes.opened(spark, str(tmp_path))
    assert again._arbordex_path == nodes._arbordex_path and again.count() == nodes.count()
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").where("r_regionkey > 0").write.mode("overwrite").parquet(f"{tmp_path}/region.parquet")
    other, _ = volumes.opened(spark, str(tmp_path))
    assert other.count() == nodes.count() - 1


def test_merge(spark):
    old = nodes_of(spark, [(50, 40, "x.dll", 7, False), (50, 41, "y.dll", 7, False), (51, 40, "z", 1, False)])
    new = nodes_of(spark, [(51, 40, "other", 9, False), (52, 40, "new", 2, False)])
    assert {(r.record_number, r.name, r.file_size) for r in merge.upsert(old, new).collect()} == {(50, "x.dll", 7), (50, "y.dll", 7), (51, "z", 9), (52, "new", 2)}
    overlay = spark.createDataFrame([(50, 99, 1, 2)], "file_reference_number long, file_size long, creation_time long, modification_time long")
    assert {(r.record_number, r.file_size, r.allocated_size, r.modification_time) for r in merge.refresh(old, overlay).collect()} == {(50, 99, 7, 2), (51, 1, 1, 0)}
    found = spark.createDataFrame([("C", 40, 5, "dir"), ("C", 7, 5, "unused")], "drive string, record_number long, parent_record_number long, name string")
    assert {r.record_number for r in merge.parent_overlay(old, found).collect()} == {50, 51, 40}
    assert merge.hard_links(old).collect()[0].links == 2


def test_extent_joins_agree(spark):
    e = spark.createDataFrame([("C", 0, 0, 1000, 10), ("C", 1, 10, 70, 100_000)], "drive string, seq int, vcn long, lcn long, clusters long")
    rows = spark.range(0, 500_000, 997).select(F.lit("C").alias("drive"), F.col("id").alias("record_number"))
    one, two = (sorted(map(tuple, extents.record_offsets(rows, e, 5, 4096, 1024, small).collect())) for small in (True, False))
    assert one == two and one[0] == ("C", 0, 1000 * 4096)


@pytest.mark.parametrize("profile", [treemap.cells(), treemap.pixels()])
def test_treemap(spark, profile):
    nodes = nodes_of(spark, [(5, 5, ".", 0, True), (10, 5, "a", 0, True), (11, 5, "b.txt", 30, False), (12, 10, "c", 50, False), (13, 10, "d", 20, False), (14, 10, "e", 0, False)])
    boxes = {r.record_number: r for r in treemap.treemap(tree.rollup(nodes), profile).collect()}
    assert set(boxes) == {10, 11, 12, 13}
    area = lambda b: b.w * b.h
    assert area(boxes[10]) == pytest.approx(0.7) and area(boxes[11]) == pytest.approx(0.3)
    assert boxes[10].children_rendered and area(boxes[12]) / area(boxes[13]) == pytest.approx(2.5)
    outer = boxes[10]
    for r in (12, 13):
        b = boxes[r]
        assert b.x >= outer.x and b.y >= outer.y and b.x + b.w <= outer.x + outer.w + 1e-9 and b.y + b.h <= outer.y + outer.h + 1e-9


def test_squarify_keeps_area_and_order():
    sizes = [40.0, 25, 10, 10, 8, 5, 1, 1]
    found = treemap.squarify(sizes, 0, 0, 2, 1)
    assert all(b[2] * b[3] == pytest.approx(s / 50) for s, b in zip(sizes, found, strict=True))
    for i, a in enumerate(found):
        for b in found[:i]:
            assert min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]) < 1e-9 or min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) < 1e-9
    assert treemap.squarify([1.0], 0, 0, 0.0001, 1) == [None]


def test_exports(spark, tmp_path):
    nodes = nodes_of(spark, [(5, 5, ".", 0, True), (10, 5, 'say "x"', 3, False)])
    rows = tree.paths(nodes)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.Path for r in back.collect()} == {"C:\\", 'C:\\say "x"'}
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("size = 3").count() == 1
    text = sinks.json_object(rows, tree.stats(nodes)).head()[0]
    assert '"files":1,"directories":1,"total_size":3' in text
    assert sinks.summary(tree.stats(nodes), 0.5).head().files_per_second == 2.0 and "files_per_second" not in sinks.summary(tree.stats(nodes)).columns
    assert sinks.path_list(rows.where("record_number = 10")).head()[0] == 'C:\\say "x"'


def test_selected_links(spark):
    """ag05_selection: of two links of a record in one directory, one is selected; a row without a name, too."""
    rows = nodes_of(spark, [(11, 10, "x", 9, False), (11, 10, "y", 20, False), (12, 10, None, 30, False), (13, 10, "z", 1, False)])
    one = merge.selection(rows, rows.where("file_size >= 20")).head()
    assert (one.objects, one.selected, one.label) == (4, 2, " 4 objects | 2 selected | 60 B total")
