"""The directory tree: links, orphans, paths, roll-up, statistics.

A directory's ancestors are found by doubling: each round, a chain that ends at directory x takes over x's chain, so a tree of depth d
takes log2(d) joins of directories only, whatever d is. Chains that have reached the root or a missing parent take no part in later
rounds but as what others end at. A chain that comes to a directory again is a cycle. Files never take part; they meet their directory's path, one
string, in one join at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ROOT
from ..storage import shared_folder, stored_at

KEY = ["drive", "record_number", "parent_record_number"]


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written once to the shared checkpoint folder (checkpoint() would compute it twice)."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return stored_at(df.sparkSession, path, df.schema)


def dedup(nodes: DataFrame) -> DataFrame:
    """ST02: of rows with the same parent and name (whatever its case), the first by source, record and content stays.

    One aggregation, begun before the exchange: the least of each group by that order.
    """
    rank = F.when(F.col("source") == "usn", 0).when(F.col("source") == "mft", 1).otherwise(2)
    first = ["record_number", "name", "file_size", "allocated_size", "attributes", "creation_time", "modification_time", "file_reference_number"]
    rest = [c for c in nodes.columns if c not in (*first, "drive", "parent_record_number")]
    least = F.min(F.struct(rank.alias("_rank"), *first, *rest)).alias("_row")
    found = nodes.groupBy("drive", "parent_record_number", F.lower("name").alias("_lower")).agg(least)
    return found.select("drive", "parent_record_number", *[F.col("_row")[c].alias(c) for c in (*first, *rest)]).select(*nodes.columns)


def records(nodes: DataFrame) -> DataFrame:
    """WN03: the first row of each record."""
    order = Window.partitionBy("drive", "record_number").orderBy("parent_record_number", "name")
    return nodes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def edges(nodes: DataFrame) -> DataFrame:
    """Rows that are some other row's child: all but the root."""
    return nodes.where("record_number <> parent_record_number")


def children(nodes: DataFrame, drive: str, record: int) -> DataFrame:
    """TR03, JN07"""
    return edges(nodes).where((F.col("drive") == drive) & (F.col("parent_record_number") == record))


def linked(nodes: DataFrame) -> DataFrame:
    """JN01: each row with its parent's name."""
    parents = records(nodes).select("drive", F.col("record_number").alias("parent_record_number"), F.col("name").alias("parent_name"))
    return edges(nodes).join(parents, ["drive", "parent_record_number"])


def orphans(nodes: DataFrame) -> DataFrame:
    """JN02: rows whose parent isn't there."""
    have = nodes.select("drive", F.col("record_number").alias("parent_record_number")).distinct()
    return nodes.where(~F.col("parent_record_number").isin(0, ROOT)).join(have, ["drive", "parent_record_number"], "left_anti")


def directory_chains(nodes: DataFrame) -> DataFrame:
    """For each directory: drive, record, ancestors (itself first), path, depth, state: root, missing (a parent isn't there) or cycle."""
    dirs = records(nodes.where("is_directory")).select("drive", F.col("record_number").alias("record"), F.col("parent_record_number").alias("top"), "name")
    root = F.col("record") == ROOT
    state = F.when(root, "root").when(F.col("top") == 0, "missing")
    open_ = dirs.select("drive", "record", "top", F.array("record").alias("ancestors"), F.when(root, F.array().cast("array<string>")).otherwise(F.array("name")).alias("names"), state.alias("state"))
    done: DataFrame | None = None
    while True:
        now = cut_lineage(open_)
        closed, open_ = now.where("state IS NOT NULL"), now.where("state IS NULL")
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            break
        upper = done.unionByName(open_).select("drive", F.col("record").alias("top"), F.col("top").alias("_top"), F.col("ancestors").alias("_ancestors"), F.col("names").alias("_names"), F.coalesce("state", F.lit("open")).alias("_state"))
        met = open_.join(upper, ["drive", "top"], "left")
        there = F.col("_state").isNotNull()
        ancestors = F.when(there, F.concat("ancestors", "_ancestors")).otherwise(F.col("ancestors"))
        names = F.when(there, F.concat("names", "_names")).otherwise(F.col("names"))
        more = met.select("drive", "record", F.coalesce("_top", "top").alias("top"), ancestors.alias("ancestors"), names.alias("names"), F.coalesce(F.nullif("_state", F.lit("open")), F.when(~there, "missing")).alias("state"))
        # A chain that comes to a directory again is cut there.
        first = F.size(F.array_distinct("ancestors"))
        again = first < F.size("ancestors")
        cut = {c: F.when(again, F.slice(c, F.lit(1), first)).otherwise(F.col(c)) for c in ("ancestors", "names")}
        open_ = more.withColumns(cut | {"state": F.when(again, "cycle").otherwise(F.col("state"))})
    return done.select("drive", "record", "ancestors", _path(F.col("drive"), F.col("names")).alias("path"), F.size("names").alias("depth"), "state")


def _path(drive: Column, names: Column) -> Column:
    """X:\\a\\b of names from the innermost out; X:\\ if there are none."""
    return F.when(F.size(names) == 0, F.concat(drive, F.lit(":\\"))).otherwise(F.concat_ws("\\", F.concat(drive, F.lit(":")), F.array_join(F.reverse(names), "\\")))


def with_paths(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """JN08: rows with path, parent_path, depth and path_complete. Filter first: only the rows that are left are joined."""
    parents = chains.select("drive", F.col("record").alias("parent_record_number"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("state").alias("_state"))
    met = rows.join(parents, ["drive", "parent_record_number"], "left")
    root = (F.col("record_number") == ROOT) & (F.col("parent_record_number") == ROOT)
    top = F.concat("drive", F.lit(":\\"))
    parent = F.coalesce("_path", top)
    path = F.when(root, top).when(F.endswith(parent, F.lit("\\")), F.concat(parent, F.col("name"))).otherwise(F.concat(parent, F.lit("\\"), F.col("name")))
    depth = F.when(root, 0).otherwise(F.coalesce("_depth", F.lit(0)) + 1)
    return met.withColumns({"parent_path": parent, "path": path, "depth": depth, "path_complete": root | F.coalesce(F.col("_state") == "root", F.lit(False))}).drop("_path", "_depth", "_state")


def paths(nodes: DataFrame) -> DataFrame:
    return with_paths(nodes, directory_chains(nodes))


def rollup(nodes: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """AG01: nodes with total_size, total_allocated, file_count and dir_count. Rows that the root doesn't reach keep their own values.

    Each directory's own rows are summed first; those sums, not the files, go to all of its ancestors.
    """
    chains = directory_chains(nodes) if chains is None else chains
    is_file = F.when(F.col("is_directory"), 0).otherwise(1)
    own = edges(nodes).groupBy("drive", F.col("parent_record_number").alias("record")).agg(F.sum("file_size").alias("size"), F.sum("allocated_size").alias("allocated"), F.sum(is_file).alias("files"), F.sum(1 - is_file).alias("dirs"))
    reached = chains.where("state = 'root'").select("drive", "record", "ancestors")
    up = reached.join(own, ["drive", "record"]).select("drive", F.explode("ancestors").alias("record_number"), "size", "allocated", "files", "dirs")
    sums = up.groupBy("drive", "record_number").agg(*[F.sum(c).alias(c) for c in ("size", "allocated", "files", "dirs")])
    met = nodes.join(sums, ["drive", "record_number"], "left")
    below = lambda c: F.when(F.col("is_directory"), F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    return met.withColumns({
        "total_size": F.col("file_size") + below("size"), "total_allocated": F.col("allocated_size") + below("allocated"),
        "file_count": is_file + below("files"), "dir_count": 1 - is_file + below("dirs"),
    }).drop("size", "allocated", "files", "dirs")


def stats(nodes: DataFrame) -> DataFrame:
    """AG02, SK03: a row for each drive, of one written table."""
    nodes = cut_lineage(nodes.select(*KEY, "name", "is_directory", "file_size", "allocated_size"))
    file = ~F.col("is_directory")
    lost = orphans(nodes).groupBy("drive").agg(F.count("*").alias("orphaned"))
    unique = records(nodes).groupBy("drive").agg(F.count_if(file).alias("unique_files"), F.coalesce(F.sum(F.when(file, F.col("file_size"))), F.lit(0)).alias("unique_size"))
    sums = nodes.groupBy("drive").agg(F.count_if(file).alias("files"), F.count_if(F.col("is_directory")).alias("directories"), F.coalesce(F.sum(F.when(file, F.col("file_size"))), F.lit(0)).alias("total_size"), F.coalesce(F.sum(F.when(file, F.col("allocated_size"))), F.lit(0)).alias("total_allocated"))
    return sums.join(lost, "drive", "left").join(unique, "drive").withColumn("orphaned", F.coalesce("orphaned", F.lit(0)))


def totals(per_drive: DataFrame) -> DataFrame:
    """AG03"""
    return per_drive.agg(F.count("*").alias("volumes"), *[F.sum(c).alias(c) for c in ("files", "directories", "total_size", "total_allocated", "orphaned")])


def largest_directories(rolled: DataFrame, count: int = 20) -> DataFrame:
    """TK02, PJ04: the largest directories, with their totals as file_size and allocated_size."""
    top = rolled.where("is_directory").orderBy(F.desc("total_size"), *KEY).limit(count)
    return top.withColumns({"file_size": F.col("total_size"), "allocated_size": F.col("total_allocated")})


def top_children(rolled: DataFrame, most) -> DataFrame:
    """WN01, TK03, TK04: the largest children of each directory, ranked. most: a number or column."""
    order = Window.partitionBy("drive", "parent_record_number").orderBy(F.desc("total_size"), "record_number", "name")
    return edges(rolled).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def tree_size(rolled: DataFrame, chains: DataFrame, max_depth: int = 3, most: int = 10, start: int = ROOT) -> DataFrame:
    """TK03: directories down to max_depth that are among the largest children (files count there) all the way from the start.

    A row is shown if all of its ancestors below the start are: kept directories meet their chains, no level loop is needed.
    """
    kept = top_children(rolled, most).where("is_directory").select("drive", "record_number", "parent_record_number", "name", "total_size", "file_count", "dir_count", "rank")
    at = F.array_position("ancestors", start)
    inner = chains.where((F.col("state") == "root") & (at > 0) & (at <= max_depth + 1)).select("drive", F.col("record").alias("record_number"), F.slice("ancestors", F.lit(1), (at - 1).cast("int")).alias("line"), (at - 1).cast("int").alias("depth"))
    shown = inner.where("depth > 0").select("drive", "record_number", "depth", F.explode("line").alias("step")).join(kept.select("drive", F.col("record_number").alias("step")), ["drive", "step"])
    shown = shown.groupBy("drive", "record_number", "depth").agg(F.count("*").alias("n")).where("n = depth").drop("n")
    top = records(rolled).where(F.col("record_number") == start).select("drive", "record_number", "parent_record_number", "name", "total_size", "file_count", "dir_count", F.lit(1).alias("rank"), F.lit(0).alias("depth"))
    return top.unionByName(kept.join(shown, ["drive", "record_number"]))


def trace(nodes: DataFrame, drive: str, record: int, steps: int = 20) -> DataFrame:
    """TR01: the chain of parents of one record: step, record_number, parent_record_number, name."""
    start = records(nodes.where(F.col("drive") == drive))
    rows = start.where(F.col("record_number") == record).select(F.lit(0).alias("step"), "record_number", "parent_record_number", "name")
    above = directory_chains(nodes.where(F.col("drive") == drive)).join(rows.select(F.col("parent_record_number").alias("record")), "record")
    above = above.select(F.posexplode("ancestors")).select((F.col("pos") + 1).alias("step"), F.col("col").alias("record_number"))
    above = above.join(start.select("record_number", "parent_record_number", "name"), "record_number").select("step", "record_number", "parent_record_number", "name")
    return rows.unionByName(above).where(F.col("step") <= steps)
