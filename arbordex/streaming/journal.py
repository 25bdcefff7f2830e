"""The change journal: batch functions that a stream applies to each micro-batch, and the stateful fold.

A record's state is what the last change left: it is keyed by (drive, record), changes are applied in the order of usn, and a change
whose usn isn't above the state's is ignored, so replays do nothing. State is one small row for each record; no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import classify_reason
from ..schema import REASONS
from ..sources import image
from ..sources.image import JOURNAL, MASK

STATE = "drive string, record_number long, parent_record_number long, name string, attributes long, exists boolean, needs_refresh boolean, last_usn long"


def changes(journal: DataFrame) -> DataFrame:
    """SR02, FN19: named changes; those that are neither closed nor of a known kind are left out."""
    rows = journal.withColumn("reason", classify_reason(F.col("reason_bits")))
    return rows.where((F.col("reason_bits").bitwiseAND(F.lit(REASONS["close"])) != 0) | (F.col("reason") != "Other"))


def monitored(journal: DataFrame, mask: int = MASK) -> DataFrame:
    """SR01: records with at least one of the reasons that a monitor asks for."""
    return journal.where(F.col("reason_bits").bitwiseAND(F.lit(mask)) != 0)


def poll(spark: SparkSession, path: str, drive: str = "C", start: int | str = "latest", mask: int = MASK, pages: int = image.PAGES) -> DataFrame:
    """SR01, SR04, SR05: a stream over the pages of a journal from a usn, its end (new changes only) or its beginning on; the checkpoint is
    its position after that."""
    image.register(spark)
    return spark.readStream.format("journal_pages").options(path=path, drive=drive, start=start, mask=mask, pages=pages).load()


def pages(spark: SparkSession, path: str, drive: str = "C", start: int | str = "earliest", mask: int = MASK) -> DataFrame:
    """SR01 as a batch: the records of a journal's pages."""
    image.register(spark)
    return spark.read.format("journal_pages").options(path=path, drive=drive, start=start, mask=mask).load()


def read_journal(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A stream over journal tables that are decoded already; the checkpoint is its position."""
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files).parquet(path)


def since(journal: DataFrame, usn: int | None) -> DataFrame:
    """SR04, SR05: changes from a position on; None: all."""
    return journal if usn is None else journal.where(F.col("usn") >= usn)


def next_usn(journal: DataFrame) -> DataFrame:
    """SR05: where a monitor of new changes starts."""
    return journal.groupBy("drive").agg((F.max("usn") + 1).alias("next_usn"))


def fold(journal: DataFrame, created_only: bool = False) -> DataFrame:
    """SR03 over a whole journal: each record's last state (STATE). Deleted records stay, as not existing.

    created_only: only creations count, and only the first of each record.
    """
    rows = changes(journal)
    if created_only:
        first = rows.where("reason = 'Created'").groupBy("drive", "record_number").agg(F.min_by(F.struct("parent_record_number", "name", "attributes", "usn"), "usn").alias("r"))
        return first.select("drive", "record_number", "r.parent_record_number", "r.name", "r.attributes", F.lit(True).alias("exists"), F.lit(False).alias("needs_refresh"), F.col("r.usn").alias("last_usn"))
    last = Window.partitionBy("drive", "record_number")
    # A modification since the last creation, deletion or refresh of the name leaves sizes unknown.
    rows = rows.withColumn("_born", F.max(F.when(F.col("reason").isin("Created", "Deleted"), F.col("usn"))).over(last))
    modified = F.max(F.when((F.col("reason").isin("Modified", "AttributeChange", "SecurityChange", "Other")) & (F.col("usn") > F.coalesce("_born", F.lit(-1))), True))
    named = F.max_by(F.struct("parent_record_number", "name", "attributes"), F.when(F.col("reason") != "RenamedFrom", F.col("usn")))
    out = rows.groupBy("drive", "record_number").agg(named.alias("r"), F.max_by("reason", "usn").alias("reason"), F.max("usn").alias("last_usn"), modified.alias("m"), F.max_by(F.col("reason") != "Deleted", F.when(F.col("reason").isin("Created", "Deleted"), F.col("usn"))).alias("alive"))
    return out.select("drive", "record_number", "r.parent_record_number", "r.name", "r.attributes", F.coalesce("alive", F.lit(True)).alias("exists"), F.coalesce("m", F.lit(False)).alias("needs_refresh"), "last_usn")


_FIELDS = ["parent_record_number", "name", "attributes", "exists", "needs_refresh", "last_usn"]


def _last(part: pd.DataFrame, rows: pd.Series) -> int:
    """The place of the last of these rows; -1 if there is none."""
    return int(rows.to_numpy().nonzero()[0][-1]) if rows.any() else -1


def _apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    parent, name, attributes, exists, stale, last = state.get if state.exists else (None, None, None, True, False, -1)
    for part in parts:
        part = part[part["usn"] > last].sort_values("usn").drop_duplicates("usn", keep="first").reset_index(drop=True)
        if part.empty:
            continue
        last = int(part["usn"].iloc[-1])
        named, born = _last(part, part["reason"] != "RenamedFrom"), _last(part, part["reason"].isin(["Created", "Deleted"]))
        touched = _last(part, ~part["reason"].isin(["Created", "Deleted", "RenamedFrom", "RenamedTo"]))
        if named >= 0:
            row = part.iloc[named]
            parent, name, attributes = int(row["parent_record_number"]), row["name"], int(row["attributes"])
        if born >= 0:
            exists = part["reason"].iloc[born] == "Created"
        stale = bool(touched > born if max(touched, born) >= 0 else stale)
    state.update((parent, name, attributes, bool(exists), stale, last))
    yield pd.DataFrame([[*key, parent, name, attributes, bool(exists), stale, last]], columns=["drive", "record_number", *_FIELDS])


def apply_stream(journal: DataFrame) -> DataFrame:
    """SR03 over a stream: the new state of each record that a micro-batch changes. Micro-batches must come in the order of usn."""
    kinds = T._parse_datatype_string(STATE)
    state = T.StructType([f for f in kinds.fields if f.name in _FIELDS])
    return changes(journal).groupBy("drive", "record_number").applyInPandasWithState(_apply, kinds, state, "update", GroupStateTimeout.NoTimeout)
