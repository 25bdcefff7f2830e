"""Data sources over raw bytes: volume images by byte ranges, and the pages of a change journal.

An image is never read whole: the driver looks at the boot sector and at the table's own record, a few KB; then each partition reads
its stretch of records, cut at extents and at SPLIT records, through pyarrow's file systems (local paths, or any URI that those open).

volume_image    options: path, drive, offset (where the volume starts), records ('40,41': only these), split;
                layout: volume (default), or table (a bare record table), which takes record_size
journal_pages   options: path (a folder of files named by their first usn, each an 8-byte cursor and records), drive, start (a usn,
                earliest or latest), mask (reason bits, 0: all), pages (so many a task); to read or to stream, the offset is a usn
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import REASONS
from . import layouts

RAW = "drive string, record_number long, data binary"
JOURNAL = "drive string, record_number long, parent_record_number long, name string, reason_bits long, attributes long, usn long, timestamp long"
SPLIT = 1 << 16
BATCH = 4096
PAGES = 64
# Fixed value: the reasons that a monitor asks for.
MONITORED = ["file_create", "file_delete", "rename_old_name", "rename_new_name", "data_overwrite", "data_extend", "data_truncation", "basic_info_change", "security_change"]
MASK = sum(REASONS[n] for n in MONITORED)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_at(path: str, offset: int, size: int) -> bytes:
    """SC12: bytes of an image; fewer at its end."""
    files, place = _at(path)
    with files.open_input_file(place) as f:
        return f.read_at(size, offset)


@dataclass(frozen=True)
class Table:
    """SC06, SC11: where a volume's records are. extents: (first byte of the table, byte in the image, bytes)."""

    record_size: int
    records: int
    extents: tuple[tuple[int, int, int], ...]
    geometry: dict | None = None

    def pieces(self, first: int, end: int) -> list[tuple[int, int]]:
        """(byte in the image, bytes) of records from first to end."""
        low, high = first * self.record_size, end * self.record_size
        found = [(place + max(low, start) - start, min(high, start + size) - max(low, start)) for start, place, size in self.extents]
        return [(place, size) for place, size in found if size > 0]


def open_table(path: str, offset: int = 0, layout: str = "volume", record_size: int = 1024) -> Table:
    files, place = _at(path)
    if layout == "table":
        size = files.get_file_info(place).size - offset
        return Table(record_size, max(0, size // record_size), ((0, offset, size),))
    boot = layouts.boot_sector(read_at(path, offset, 512))
    if boot is None:
        raise ValueError(f"no valid boot sector at {offset} of {path}")
    cluster, size = boot["bytes_per_cluster"], boot["bytes_per_record"]
    own = layouts.mft_record(read_at(path, offset + boot["mft_lcn"] * cluster, size), 0)
    if own.error or not own.runs:
        raise ValueError(f"the table's own record can't be read: {own.error or 'no runs'}")
    found, at = [], 0
    for clusters, lcn, sparse in own.runs:
        if not sparse:
            found.append((at, offset + lcn * cluster, clusters * cluster))
        at += clusters * cluster
    return Table(size, min(at, own.file_size or at) // size, tuple(found), boot)


@dataclass
class _Stretch(InputPartition):
    first: int
    end: int
    pieces: list

    def __init__(self, first: int, end: int, pieces: list) -> None:
        self.first, self.end, self.pieces = first, end, pieces


class _ImageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.drive, self.offset = options["path"], options.get("drive", "C"), int(options.get("offset", 0))
        self.layout, self.size, self.split = options.get("layout", "volume"), int(options.get("record_size", 1024)), int(options.get("split", SPLIT))
        self.wanted = sorted({int(x) for x in options.get("records", "").split(",") if x.strip()})
        self.table = open_table(self.path, self.offset, self.layout, self.size)
        if beyond := [n for n in self.wanted if not 0 <= n < self.table.records]:
            raise ValueError(f"short read: the table has {self.table.records} records, not number {beyond[0]}")

    def partitions(self) -> list[_Stretch]:
        """SC04: stretches of records, cut where an extent ends."""
        t, size = self.table, self.table.record_size
        if self.wanted:
            return [_Stretch(n, n + 1, t.pieces(n, n + 1)) for n in self.wanted]
        cuts = sorted({0, t.records, *range(0, t.records, self.split), *(-(-end // size) for start, _, n in t.extents for end in (start, start + n) if end <= t.records * size)})
        found = [_Stretch(a, b, t.pieces(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return [p for p in found if sum(n for _, n in p.pieces) >= size]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        size = self.table.record_size
        files, place = _at(self.path)
        with files.open_input_file(place) as f:
            number, held = partition.first, b""
            for at, length in partition.pieces:
                for start in range(0, length, BATCH * size):
                    held += f.read_at(min(BATCH * size, length - start), at + start)
                    n = len(held) // size
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([self.drive] * n), pa.array(range(number, number + n), pa.int64()), pa.array([held[i * size : (i + 1) * size] for i in range(n)], pa.binary())], names=["drive", "record_number", "data"])
                        number, held = number + n, held[n * size :]
            if self.wanted and number < partition.end:
                raise ValueError(f"short read of record {number}")


class VolumeImage(DataSource):
    """SC02-SC04, SC11, SC12, SC16"""

    @classmethod
    def name(cls) -> str:
        return "volume_image"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _ImageReader(dict(self.options))


class _Page(InputPartition):
    def __init__(self, paths: list[str], start: int, end: int) -> None:
        self.paths, self.start, self.end = paths, start, end


class _Pages:
    """The files of a journal, and their records between two positions."""

    def __init__(self, options: dict) -> None:
        self.path, self.drive, self.start = options["path"], options.get("drive", "C"), options.get("start", "earliest")
        self.mask, self.most = int(options.get("mask", MASK)), int(options.get("pages", PAGES))

    def files(self) -> list[tuple[int, str]]:
        files, place = _at(self.path)
        found = files.get_file_info(fs.FileSelector(place))
        return sorted((int(f.base_name.split(".")[0]), f.path) for f in found if f.is_file and f.base_name.split(".")[0].isdigit())

    def cursor(self, place: str) -> int:
        files, _ = _at(self.path)
        with files.open_input_file(place) as f:
            return int.from_bytes(f.read_at(8, 0), "little")

    def end(self) -> int:
        """SR04, SR05: the position after the last page."""
        found = self.files()
        return self.cursor(found[-1][1]) if found else 0

    def first(self) -> int:
        found = self.files()
        return self.end() if self.start == "latest" else found[0][0] if found and self.start == "earliest" else 0 if self.start == "earliest" else int(self.start)

    def between(self, start: int, end: int) -> list[_Page]:
        found = self.files()
        after = [n for n, _ in found[1:]] + [1 << 62]
        wanted = [place for (n, place), following in zip(found, after, strict=True) if n < end and following > start]
        return [_Page(wanted[i : i + self.most], start, end) for i in range(0, len(wanted), self.most)]

    def records(self, part: _Page) -> Iterator[pa.RecordBatch]:
        files, _ = _at(self.path)
        names = ["record_number", "parent_record_number", "name", "reason_bits", "attributes", "usn", "timestamp"]
        for path in part.paths:
            with files.open_input_file(path) as f:
                _, found = layouts.usn_page(f.read())
            rows = [r for r in found if part.start <= r["usn"] < part.end and (not self.mask or r["reason_bits"] & self.mask)]
            columns = [pa.array([r[n].encode("utf-8", "replace").decode() if n == "name" else r[n] for r in rows], pa.string() if n == "name" else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([self.drive] * len(rows), pa.string()), *columns], names=["drive", *names])


class _JournalReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pages = _Pages(options)

    def partitions(self) -> list[_Page]:
        return self.pages.between(self.pages.first(), self.pages.end())

    def read(self, partition: _Page) -> Iterator[pa.RecordBatch]:
        yield from self.pages.records(partition)


class _JournalStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"usn": self.pages.first()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"usn": self.pages.end()}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return self.pages.between(start["usn"], end["usn"]) if start["usn"] < end["usn"] else []

    def read(self, partition: _Page) -> Iterator[pa.RecordBatch]:
        yield from self.pages.records(partition)


class JournalPages(DataSource):
    """SR01, SR04, SR05"""

    @classmethod
    def name(cls) -> str:
        return "journal_pages"

    def schema(self) -> str:
        return JOURNAL

    def reader(self, schema) -> DataSourceReader:
        return _JournalReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _JournalStream(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (VolumeImage, JournalPages):
        spark.dataSource.register(source)
