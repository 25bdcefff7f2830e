"""What the operators share: the cluster's shared folder, batch limits and source tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_folder, stored_at

#: Arrow batches sent to Python hold at most this many rows and about this many bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


_sent: set[str] = set()


def tune(spark: SparkSession) -> None:
    """Send this package to the executors and bound the Arrow batches that Python workers get (texts may be long, so by bytes too)."""
    if (app := spark.sparkContext.applicationId) not in _sent:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="arbordex-")) / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))
        _sent.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors. It goes by discard(), or when the session ends."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    conf.set(cleanup, "true")  # this write's shuffle files go as soon as it ends: what it gave is in the table
    try:
        df.write.parquet(path)
    finally:
        conf.set(cleanup, before)
    release(df.sparkSession)
    return stored_at(df.sparkSession, path, df.schema)


def release(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts of steps whose results are written: executors keep them until the driver's garbage is collected, and an
    operator of many steps would fill their memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shards(spark: SparkSession) -> int:
    """Into how many parts operators deal their intermediate rows: as many as the session's shuffles have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(column: pa.Array) -> pa.Array:
    """The column as a flat array of strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def free(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever the case."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def row_key(text: str = "text"):
    """Tells rows with the same doc_id apart; equal rows may share it."""
    return F.xxhash64(F.col(text))


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "discard", "documents", "free", "release", "row_key", "shards", "shared_folder", "texts_of", "tune", "written"]
