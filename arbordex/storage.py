"""Tables that steps write to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: the context's checkpoint folder, or on a local master a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="arbordex-"))
            known = context._jsc.sc().getCheckpointDir()
        folder = known.get()
    return folder.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored_at(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table written there. It goes when the session's JVM ends, at the latest."""
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    rows = spark.read.schema(schema).parquet(path)
    rows._arbordex_path = path
    return rows


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored_at() that nothing reads any more."""
    for t in tables:
        files, at = _files(t.sparkSession, t._arbordex_path)
        files.delete(at, True)


def there(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def age(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder was last changed, and its bytes."""
    files, at = _files(spark, path)
    return files.getFileStatus(at).getModificationTime(), files.getContentSummary(at).getLength()
