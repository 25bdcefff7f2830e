"""Where records are on a volume: runs, extents and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extent_map(runs: DataFrame) -> DataFrame:
    """SC06, AG10: runs (drive, seq, lcn, clusters, sparse) with the virtual cluster they start at, and without sparse ones."""
    before = Window.partitionBy("drive").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("vcn", F.coalesce(F.sum("clusters").over(before), F.lit(0))).where("NOT sparse")


def coverage(extents: DataFrame, bytes_per_cluster: int, bytes_per_record: int) -> DataFrame:
    """AG10: the records that each extent holds."""
    first = F.floor(F.col("vcn") * bytes_per_cluster / bytes_per_record)
    return extents.withColumns({"start_record": first, "end_record": F.floor((F.col("vcn") + F.col("clusters")) * bytes_per_cluster / bytes_per_record) - 1})


#: Extents of so many rows at most are broadcast; an MFT has a few hundred.
BROADCAST_EXTENTS = 100_000
#: Beyond that, the lookup is an equi-join on stretches of so many clusters.
STRETCH = 1 << 16


def record_offsets(records: DataFrame, extents: DataFrame, mft_lcn: int, bytes_per_cluster: int, bytes_per_record: int, small: bool | None = None) -> DataFrame:
    """SC05, JN09: the byte offset of each record; outside all extents, as if the table were in one piece. extents must not overlap."""
    position = F.col("record_number") * bytes_per_record
    rows = records.withColumns({"_vcn": F.floor(position / bytes_per_cluster), "_inner": position % bytes_per_cluster})
    e = extents.select(F.col("drive").alias("_drive"), F.col("vcn").alias("_start"), F.col("lcn").alias("_lcn"), F.col("clusters").alias("_n"))
    inside = (F.col("drive") == F.col("_drive")) & (F.col("_vcn") >= F.col("_start")) & (F.col("_vcn") < F.col("_start") + F.col("_n"))
    if small is None:
        small = e.limit(BROADCAST_EXTENTS + 1).count() <= BROADCAST_EXTENTS
    if small:
        met = rows.join(F.broadcast(e), inside, "left")
    else:
        e = e.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_start") / STRETCH), F.floor((F.col("_start") + F.col("_n") - 1) / STRETCH))))
        met = rows.withColumn("_at", F.floor(F.col("_vcn") / STRETCH)).join(e, inside & (F.col("_at") == F.col("_stretch")), "left").drop("_at", "_stretch")
    offset = F.coalesce((F.col("_lcn") + F.col("_vcn") - F.col("_start")) * bytes_per_cluster + F.col("_inner"), F.lit(mft_lcn * bytes_per_cluster) + position)
    return met.withColumn("byte_offset", offset).drop("_vcn", "_inner", "_drive", "_start", "_lcn", "_n")


def held(points: DataFrame, extents: DataFrame) -> DataFrame:
    """The distinct (drive, vcn) of points that an extent holds. Extents may overlap and be of any length and number.

    A point is held if some extent that starts at or before it ends after it: a running maximum of ends in each stretch, over that of all stretches before. No
    pair of a point and an extent is ever made.
    """
    at = points.select("drive", "vcn").distinct().select("drive", "vcn", F.lit(None).cast("long").alias("_end"), F.lit(1).alias("_point"))
    both = at.unionByName(extents.select("drive", "vcn", (F.col("vcn") + F.col("clusters")).alias("_end"), F.lit(0).alias("_point"))).where("drive IS NOT NULL AND vcn IS NOT NULL")
    both = both.withColumn("_stretch", F.floor(F.col("vcn") / STRETCH))
    before = Window.partitionBy("drive").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("drive", "_stretch").agg(F.max("_end").alias("_most")).select("drive", "_stretch", F.max("_most").over(before).alias("_carried"))
    here = Window.partitionBy("drive", "_stretch").orderBy("vcn", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.join(ends, ["drive", "_stretch"]).withColumn("_reach", F.greatest(F.max("_end").over(here), "_carried"))
    return met.where((F.col("_point") == 1) & (F.col("_reach") > F.col("vcn"))).select("drive", "vcn")
