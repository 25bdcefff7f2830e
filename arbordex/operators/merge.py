"""Hard links, merging of sources, and overlays: set operations on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import format_size
from .tree import KEY

_TIMES = ["file_reference_number", "creation_time", "modification_time"]


def expand_links(entries: DataFrame, strict: bool = False) -> DataFrame:
    """JN05: a row for each link of a record. entries: nodes with links array<struct<parent, name>>, the primary link among them or not.

    strict: a second link in the same directory is lost, as one key has one row.
    """
    base = [c for c in entries.columns if c != "links"]
    link = lambda rank, parent, name: F.struct(F.lit(rank).alias("rank"), parent.alias("parent"), name.alias("name"))
    primary, own = F.array(link(0, F.col("parent_record_number"), F.col("name"))), lambda x: (x["parent"] == F.col("parent_record_number")) & (x["name"] == F.col("name"))
    more = F.transform(F.filter("links", lambda x: ~own(x)), lambda x: link(1, x["parent"], x["name"]))
    # One pass over entries: a union of primary and other links would make them twice.
    rows = entries.withColumn("_link", F.explode(F.concat(primary, F.coalesce(more, F.slice(primary, F.lit(1), F.lit(0))))))
    values = {"parent_record_number": F.col("_link.parent"), "name": F.col("_link.name"), "source": F.when(F.col("_link.rank") == 1, "link").otherwise(F.col("source"))}
    both = rows.withColumns(values | {"_rank": F.col("_link.rank"), "_lower": F.lower("_link.name")}).select(*base, "_rank", "_lower")
    same = KEY if strict else [*KEY, "_lower"]
    order = Window.partitionBy(*same).orderBy("_rank", "name")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_lower", "_rank")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN03: rows of both. Where a key is in both, new decides sizes, its times and reference if they are known (not 0), and nothing else."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full_outer")
    there = F.col("o.record_number").isNotNull()

    def merged(c: str):
        if c in ("file_size", "allocated_size"):
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c in _TIMES:
            return F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit(0)), F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return joined.select(*[merged(c).alias(c) for c in old.columns])


def propagate(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """JN06, SC18: all links of a record take the record's metadata. updates: drive, record_number, file_size, allocated_size and _TIMES."""
    u = updates.select("drive", "record_number", *[F.col(c).alias(f"_{c}") for c in ("file_size", "allocated_size", *_TIMES)])
    met = nodes.join(u, ["drive", "record_number"], "left")
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("file_size", "allocated_size")} | {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit(0)), F.col(c)) for c in _TIMES}
    return met.withColumns(values).select(*nodes.columns)


def refresh(nodes: DataFrame, overlay: DataFrame) -> DataFrame:
    """SC18: sizes and times by file reference, for every link of the record. References without a row are skipped. Roll up again after it."""
    found = nodes.select("drive", "record_number", "file_reference_number").distinct().join(overlay.dropDuplicates(["file_reference_number"]), "file_reference_number")
    found = found.withColumn("allocated_size", F.lit(None).cast("long")).dropDuplicates(["drive", "record_number"])
    return propagate(nodes, found.withColumn("file_reference_number", F.lit(0).cast("long")))


def parent_overlay(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """SC17: directories that are missing but known elsewhere (drive, record_number, parent_record_number, name) join the nodes."""
    have = nodes.select("drive", "record_number").distinct()
    lost = nodes.select("drive", F.col("parent_record_number").alias("record_number")).distinct().join(have, ["drive", "record_number"], "left_anti")
    rows = parents.join(lost, ["drive", "record_number"], "left_semi")
    zero = {c: F.lit(0).cast("long") for c in ("file_reference_number", "file_size", "allocated_size", "creation_time", "modification_time")}
    rows = rows.withColumns(zero | {"attributes": F.lit(16).cast("long"), "is_directory": F.lit(True), "source": F.lit("overlay")})
    return nodes.unionByName(rows.select(*nodes.columns))


def union_volumes(volumes: list[DataFrame]) -> DataFrame:
    """ST01, SC20: all volumes; of those with the same drive, only the first counts."""
    rows = volumes[0].withColumn("_volume", F.lit(0))
    for i, v in enumerate(volumes[1:], 1):
        rows = rows.unionByName(v.withColumn("_volume", F.lit(i)))
    first = rows.groupBy("drive").agg(F.min("_volume").alias("_volume"))
    return rows.join(first, ["drive", "_volume"], "left_semi").drop("_volume").select(*volumes[0].columns)


def hard_links(nodes: DataFrame, least: int = 2) -> DataFrame:
    """AG08: records with several links, and these."""
    link = F.struct("parent_record_number", "name")
    found = nodes.where("NOT is_directory").groupBy("drive", "record_number").agg(F.count("*").alias("links"), F.array_sort(F.collect_list(link)).alias("link_list"))
    return found.where(F.col("links") >= least)


def last_rows(rows: DataFrame) -> DataFrame:
    """SC08: of an enumeration, the last row of each record. rows: with usn."""
    return rows.groupBy("drive", "record_number").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("drive", "record_number")]), F.col("usn")).alias("_r")).select("drive", "record_number", "_r.*").select(*rows.columns)


def usn_counts(rows: DataFrame) -> DataFrame:
    """AG04"""
    return rows.groupBy("drive").agg(F.count_if(~F.col("is_directory")).alias("files"), F.count_if("is_directory").alias("directories"), F.count("*").alias("total"), F.max("record_number").alias("max_record"))


def changes_by_drive(rows: DataFrame) -> DataFrame:
    """AG07: pending changes by volume: how many, of how many records, and the stretch of the journal they are from."""
    return rows.groupBy("drive").agg(F.count("*").alias("changes"), F.count_distinct("record_number").alias("records"), F.min("usn").alias("first_usn"), F.max("usn").alias("last_usn"))


def counted(nodes: DataFrame) -> DataFrame:
    """AG11: how many rows each volume has; an empty table gives none (nodes.isEmpty() says so at once)."""
    return nodes.groupBy("drive").agg(F.count("*").alias("length"))


def selection(results: DataFrame, selected: DataFrame, cursor: bool = True) -> DataFrame:
    """AG05: how many results there are and how many of them are selected; without any, the cursor's row counts as one.

    A row is a link: a record can have several in one directory, so the name counts, too. Unknown values equal each other.
    """
    marks = selected.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "name")]).distinct().withColumn("_chosen", F.lit(True))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*KEY, "name")])
    found = results.join(marks, same, "left").agg(F.count("*").alias("objects"), F.count_if(F.coalesce("_chosen", F.lit(False))).alias("selected"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))
    found = found.withColumn("selected", F.greatest("selected", F.lit(int(cursor)).cast("long")))
    return found.withColumn("label", F.concat(F.lit(" "), F.col("objects").cast("string"), F.lit(" objects | "), F.col("selected").cast("string"), F.lit(" selected | "), format_size(F.col("total_size")), F.lit(" total")))
