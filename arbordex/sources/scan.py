"""Scans: raw volume structures as rows.

A raw record table (drive, record_number, data) is split like any other table, so decoding runs in parallel, an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_size, parse_csv_fields
from ..operators.extents import held
from ..operators.merge import expand_links, upsert
from ..operators.search import visible
from ..operators.tree import cut_lineage, dedup
from ..schema import NODES
from . import image, layouts

RAW = "drive string, record_number long, data binary"
ENTRIES = (
    "drive string, record_number long, sequence int, base_record long, is_valid boolean, is_directory boolean, name string, parent_record_number long, file_size long, allocated_size long, attributes long, "
    "creation_time long, modification_time long, links array<struct<parent:long,name:string,namespace:int>>, runs array<struct<clusters:long,lcn:long,sparse:boolean>>, streams map<string,long>, "
    "name_records array<long>, data_record long, has_data boolean, error string"
)


@dataclass(frozen=True)
class ScanConfig:
    """SC01: options of a scan."""

    drive: str = "C"
    record_size: int = 1024
    offset: int = 0  # SC12: where the volume starts in an image
    hidden: bool = True
    system: bool = True
    strict_links: bool = False


def image_records(spark: SparkSession, path: str, config: ScanConfig | None = None, layout: str = "table", records: list[int] | None = None, split: int = image.SPLIT) -> DataFrame:
    """SC02-SC04: the records of an image in stretches that tasks read on their own. layout: table (an MFT alone) or volume.

    records: only these (SC03, SC16); one that the table doesn't have is an error.
    """
    config = config or ScanConfig()
    image.register(spark)
    options = {"path": path, "drive": config.drive, "offset": config.offset, "record_size": config.record_size, "layout": layout, "split": split}
    if records:
        options["records"] = ",".join(map(str, records))
    return spark.read.format("volume_image").options(**options).load()


def checked(raw: DataFrame) -> DataFrame:
    """SC16: records with whether each bears its own number (true where it bears none: older volumes don't)."""
    number = F.conv(F.hex(F.reverse(F.substring("data", 45, 4))), 16, 10).cast("long")
    return raw.withColumn("is_wanted", (F.octet_length("data") >= 48) & ((number == 0) | (number == F.col("record_number").bitwiseAND(F.lit(0xFFFFFFFF)))))


def parent_info(raw: DataFrame) -> DataFrame:
    """DC17, SC17: best name and parent of directories that are looked up one by one: drive, record_number, parent_record_number, name.

    Records that a system hands out have their sectors' ends put back already (no fixup); unused ones and those without a name are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drives, numbers, data = (batch.column(i).to_pylist() for i in range(3))
            found = [(d, n, *info) for d, n, raw in zip(drives, numbers, data, strict=True) if (info := layouts.parent_info(raw or b"")) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["drive", "record_number", "parent_record_number", "name"])

    return raw.select("drive", "record_number", "data").mapInArrow(run, "drive string, record_number long, parent_record_number long, name string")


def inspect(raw: DataFrame, extents: DataFrame, bytes_per_cluster: int, record_size: int = 1024) -> DataFrame:
    """TR02: what a record's bytes say, beside where the record is: signature, vcn, covered (an extent holds it) and ENTRIES.

    Records are decoded once, into a table of the shared folder. Extents may overlap.
    """
    decoded = decode_records(raw, head=True)
    rest = [c for c in decoded.columns if c not in ("drive", "record_number", "signature", "bytes")]
    vcn = F.floor(F.col("record_number") * record_size / bytes_per_cluster)
    rows = cut_lineage(decoded.withColumn("vcn", vcn))
    covered = held(rows.select("drive", "vcn"), extents).withColumn("covered", F.lit(True))
    return rows.join(covered, ["drive", "vcn"], "left").select("drive", "record_number", "signature", "bytes", "vcn", F.coalesce("covered", F.lit(False)).alias("covered"), *rest)


def volumes(reported: DataFrame) -> DataFrame:
    """SC14, SC19: the volumes that systems report (drive, data of 0x60 bytes) with total and free bytes; null where the data is too short."""
    names = ["bytes_per_sector", "bytes_per_cluster", "bytes_per_record", "total_clusters", "free_clusters", "mft_offset", "estimated_records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layouts.volume_data(d or b"") or {} for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f.get(n) for f in found], pa.int64()) for n in names]], names=["drive", *names])

    rows = reported.select("drive", "data").mapInArrow(run, "drive string, " + ", ".join(f"{n} long" for n in names))
    return rows.withColumns({f"{k}_bytes": F.col(f"{k}_clusters") * F.col("bytes_per_cluster") for k in ("total", "free")}).withColumns({f"{k}_text": format_size(F.col(f"{k}_bytes")) for k in ("total", "free")})


def journals(reported: DataFrame) -> DataFrame:
    """SC15: what systems report of journals (drive, data of 0x38 bytes); null where the data is too short."""
    names = ["journal_id", "first_usn", "next_usn", "lowest_usn", "max_usn", "maximum_size", "allocation_delta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layouts.journal_data(d or b"") or {} for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([None if n not in f else _signed(f[n]) for f in found], pa.int64()) for n in names]], names=["drive", *names])

    return reported.select("drive", "data").mapInArrow(run, "drive string, " + ", ".join(f"{n} long" for n in names))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


#: Values of records' fields as arrow arrays.
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
_LINK, _RUN = [("parent", pa.int64()), ("name", pa.string()), ("namespace", pa.int32())], [("clusters", pa.int64()), ("lcn", pa.int64()), ("sparse", pa.bool_())]
_VALUES = {
    "sequence": lambda e: e.sequence, "base_record": lambda e: e.base_record, "is_valid": lambda e: e.in_use, "is_directory": lambda e: e.is_directory, "name": lambda e: _clean(e.name), "parent_record_number": lambda e: e.parent,
    "file_size": lambda e: _signed(e.file_size), "allocated_size": lambda e: _signed(e.allocated_size), "attributes": lambda e: e.attributes, "creation_time": lambda e: _signed(e.created), "modification_time": lambda e: _signed(e.modified),
    "data_record": lambda e: e.data_record, "has_data": lambda e: e.has_data, "error": lambda e: e.error,
}


def _clean(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _lists(values: list[list], make) -> pa.ListArray:
    """An array of lists, of their items in one array: make gives it of all items."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), make([x for v in values for x in v]))


def _structs(kinds: list[tuple]):
    return lambda rows: pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _column(field: str, entries: list[layouts.Entry]) -> pa.Array:
    name, kind = field.split(maxsplit=1)
    if name == "links":
        return _lists([[(p, _clean(n), s) for p, n, s in e.links] for e in entries], _structs(_LINK))
    if name == "runs":
        return _lists([[(_signed(c), lcn, s) for c, lcn, s in e.runs] for e in entries], _structs(_RUN))
    if name == "name_records":
        return _lists([e.name_records for e in entries], lambda found: pa.array(found, pa.int64()))
    if name == "streams":
        return pa.array([[(k, _signed(v)) for k, v in e.streams.items()] for e in entries], pa.map_(pa.string(), pa.int64()))
    return pa.array(list(map(_VALUES[name], entries)), _KINDS[kind])


def decode_records(raw: DataFrame, without: tuple[str, ...] = (), head: bool = False) -> DataFrame:
    """DC03: raw records as ENTRIES, without some of their columns; what can't be decoded has an error. head: with signature (hexadecimal) and bytes."""
    fields = [f for f in _fields(ENTRIES) if f.split()[0] not in without]
    more = ["signature string", "bytes int"] if head else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            found = [layouts.mft_record(d or b"", n) for n, d in zip(batch.column(1).to_pylist(), data, strict=True)]
            heads = [pa.array([None if d is None else d[:4].hex().upper() for d in data], pa.string()), pa.array([None if d is None else len(d) for d in data], pa.int32())] if head else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[_column(f, found) for f in fields[2:]], *heads], names=[f.split()[0] for f in (*fields, *more)])

    return raw.select("drive", "record_number", "data").mapInArrow(run, ", ".join([*fields, *more]))


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def resolve_extensions(entries: DataFrame) -> DataFrame:
    """DC13, JN04: base records with the links and sizes that their extension records hold; names that only those hold, too.

    Extension records aren't rows of their own. Records that stay without a name are left out. Reads entries three times: pass a written table.
    """
    good = entries.where("error IS NULL AND is_valid")
    base = good.where("base_record = 0")
    # Names' and data's records are mostly the same ones; each is looked up once.
    wanted = base.select("drive", "record_number", "name_records", "data_record", F.posexplode(F.array_distinct(F.array_compact(F.concat("name_records", F.array("data_record"))))).alias("place", "extension"))
    wanted = wanted.select("drive", "record_number", "place", "extension", F.array_contains("name_records", F.col("extension")).alias("_named"), F.coalesce(F.col("data_record") == F.col("extension"), F.lit(False)).alias("_sized"))
    size = F.when(F.col("has_data"), F.struct(F.col("file_size").alias("size"), F.col("allocated_size").alias("allocated")))
    other = good.where((F.size("links") > 0) | F.col("has_data")).select("drive", F.col("record_number").alias("extension"), F.transform("links", lambda x: F.struct(x["parent"].alias("parent"), x["name"].alias("name"))).alias("more"), size.alias("_data"))
    parts = F.array_sort(F.collect_list(F.when(F.col("_named"), F.struct("place", "more"))))
    found = wanted.join(other, ["drive", "extension"]).groupBy("drive", "record_number").agg(parts.alias("_parts"), F.max(F.when(F.col("_sized"), F.col("_data"))).alias("_data"))
    met = base.join(found, ["drive", "record_number"], "left").withColumns({"_size": F.col("_data.size"), "_allocated": F.col("_data.allocated")})
    extra = F.flatten(F.transform("_parts", lambda p: p["more"]))
    first = F.get(extra, F.lit(0))
    unnamed, sized = F.col("name") == "", (F.col("file_size") == 0) & ~F.col("is_directory") & F.col("_size").isNotNull()
    own = F.transform("links", lambda x: F.struct(x["parent"].alias("parent"), x["name"].alias("name")))
    links = F.concat(own, F.coalesce(extra, F.array().cast("array<struct<parent:long,name:string>>")))
    return met.withColumns({
        "links": F.array_distinct(links),
        "parent_record_number": F.when(unnamed & (F.col("parent_record_number") == 0), F.coalesce(first["parent"], F.lit(0))).otherwise(F.col("parent_record_number")),
        "name": F.when(unnamed, F.coalesce(first["name"], F.lit(""))).otherwise(F.col("name")),
        "file_size": F.when(sized, F.col("_size")).otherwise(F.col("file_size")), "allocated_size": F.when(sized, F.col("_allocated")).otherwise(F.col("allocated_size")),
    }).where("name <> ''").drop("_parts", "_data", "_size", "_allocated")


def nodes_from_entries(entries: DataFrame, strict_links: bool = False) -> DataFrame:
    """PJ01: resolved entries as nodes, one for each link."""
    reference = F.col("record_number").bitwiseOR(F.shiftleft(F.col("sequence").cast("long"), 48))
    rows = entries.withColumns({"file_reference_number": reference, "source": F.lit("mft")}).select(*[f.name for f in NODES.fields], "links")
    return expand_links(rows, strict_links).select(*[f.name for f in NODES.fields])


def decode_pages(pages: DataFrame) -> DataFrame:
    """SC07, DC18: pages of an enumeration or journal (drive, data) as records."""
    schema = "drive string, record_number long, parent_record_number long, file_reference_number long, usn long, timestamp long, reason_bits long, attributes long, name string"
    names = [f.split()[0] for f in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r | {"drive": d} for d, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in layouts.usn_page(page or b"")[1]]
            kinds = [pa.string(), *[pa.int64()] * 7, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([(_signed(r[n]) if isinstance(r[n], int) else r[n].encode("utf-8", "replace").decode() if n == "name" else r[n]) for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return pages.select("drive", "data").mapInArrow(run, schema)


def nodes_from_journal(records: DataFrame) -> DataFrame:
    """PJ01, PJ05: journal records as nodes without sizes and times."""
    zero = {c: F.lit(0).cast("long") for c in ("file_size", "allocated_size", "creation_time", "modification_time")}
    return records.withColumns(zero | {"is_directory": F.col("attributes").bitwiseAND(F.lit(16)) != 0, "source": F.lit("usn")}).select(*[f.name for f in NODES.fields])


def scan(raw: DataFrame, config: ScanConfig | None = None, journal: DataFrame | None = None) -> DataFrame:
    """SC01: the nodes of a volume from its raw records, over those of its journal if there is one. Rows of errors are left out (FL12, FL16).

    Records are decoded once, into a table of the shared folder.
    """
    config = config or ScanConfig()
    entries = cut_lineage(decode_records(raw, ("runs", "streams")), "zstd")
    found = visible(nodes_from_entries(resolve_extensions(entries), config.strict_links), config.hidden, config.system)
    if journal is not None:
        found = upsert(visible(nodes_from_journal(journal), config.hidden, config.system), found)
    return dedup(found)


def _read(make) -> DataFrame:
    """The source's rows, after a bounded read that fails where the source would."""
    rows = make()
    rows.limit(1).collect()
    return rows


def scan_any(sources: dict[str, object]) -> tuple[DataFrame | None, dict[str, str]]:
    """SC10: the first source that works, by name, and why those before it didn't. sources: functions that give a DataFrame."""
    errors: dict[str, str] = {}
    for name, make in sources.items():
        try:
            return _read(make), errors
        except Exception as e:  # noqa: BLE001  whatever a source raises is its reason
            errors[name] = str(e)
    return None, errors


def scan_drives(sources: dict[str, object]) -> tuple[DataFrame | None, dict[str, str | None]]:
    """SC20: all volumes that can be read, in one table, and for each drive its error, or None. sources: functions of raw records by drive."""
    found, result = [], {}
    for drive, make in sources.items():
        try:
            found.append(scan(_read(make).withColumn("drive", F.lit(drive)), ScanConfig(drive=drive)))
            result[drive] = None
        except Exception as e:  # noqa: BLE001  a drive that fails doesn't stop the others
            result[drive] = str(e)
    # Each drive is one volume: union_volumes() would make all rows a second time to find that out, and put each drive into one task.
    return (reduce(DataFrame.unionByName, found) if found else None), result


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """SC21: saved filters: name, search, macro. Lines with under 7 fields or without a name are left out."""
    lines = spark.read.text(path, wholetext=False).where("trim(value) <> ''")
    fields = F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    clean = lambda i: F.trim(F.coalesce(F.get(fields, F.lit(i)), F.lit("")), F.lit('"'))
    rows = lines.where(F.size(fields) >= 7).select(clean(0).alias("name"), clean(6).alias("search"), clean(7).alias("macro"), F.get(fields, F.lit(1)).alias("_case"))
    return rows.where("name <> '' AND _case <> 'Case'").drop("_case")


def preset_line(line: str) -> dict | None:
    """SC21 for one line."""
    fields = parse_csv_fields(line)
    return {"name": fields[0], "search": fields[6], "macro": (fields + [""])[7]} if len(fields) >= 7 and fields[0] else None
