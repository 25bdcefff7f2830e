"""Exports. The file sinks write in parallel; the single JSON object is for small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_size


def csv_rows(with_paths: DataFrame, rolled_size: str = "file_size") -> DataFrame:
    """SK01: the columns of a CSV export, each link with its own path."""
    return with_paths.select(F.col("path").alias("Path"), F.col("name").alias("Name"), F.col(rolled_size).alias("Size"), F.col("allocated_size").alias("Allocated"), F.col("is_directory").alias("IsDirectory"), F.col("modification_time").alias("Modified"))


def write_csv(with_paths: DataFrame, path: str) -> None:
    csv_rows(with_paths).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def json_rows(with_paths: DataFrame) -> DataFrame:
    """SK02: one JSON text for each row."""
    return with_paths.select(F.to_json(F.struct("path", F.col("file_size").alias("size"), F.col("is_directory").alias("is_dir"))).alias("value"))


def write_json(with_paths: DataFrame, path: str) -> None:
    """SK02 for any size: JSON lines."""
    json_rows(with_paths).write.mode("overwrite").text(path)


#: The single object holds so many files at most; larger exports are for write_json().
MOST_FILES = 100_000


def json_object(with_paths: DataFrame, stats: DataFrame) -> DataFrame:
    """SK02: one object for each drive, with its statistics and files."""
    counts = with_paths.groupBy("drive").agg(F.count("*").alias("n"))
    if counts.where(F.col("n") > MOST_FILES).limit(1).count():
        raise ValueError(f"over {MOST_FILES} rows: use write_json()")
    files = with_paths.groupBy("drive").agg(F.array_sort(F.collect_list(F.struct("path", F.col("file_size").alias("size"), F.col("is_directory").alias("is_dir")))).alias("files"))
    return files.join(stats, "drive").select(F.to_json(F.struct("drive", F.struct(stats["files"], "directories", "total_size").alias("stats"), files["files"])).alias("value"))


def summary(stats: DataFrame, seconds: float | None = None) -> DataFrame:
    """SK03; AG06: with the seconds that a scan took, files a second."""
    found = stats.select("drive", "files", "directories", "total_size", format_size(F.col("total_size")).alias("total_size_text"), "total_allocated", "orphaned")
    return found if seconds is None else found.withColumn("files_per_second", F.col("files") / F.lit(max(seconds, 1e-9)))


def path_list(with_paths: DataFrame) -> DataFrame:
    """SK06: the selected paths, one a line."""
    return with_paths.agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("paths"))
