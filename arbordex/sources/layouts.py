"""On-disk structures of a volume: layouts, decoders of single values, and the encoder that tests and round trips use.

All integers are little-endian. Decoders give None (or a reason) for what is too short or invalid and never raise on bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..schema import RECORD_MASK

FILE_SIGNATURE = 0x454C4946
SECTOR = 512
END = 0xFFFFFFFF
STANDARD_INFORMATION, ATTRIBUTE_LIST, FILE_NAME, DATA = 0x10, 0x20, 0x30, 0x80
POSIX, WIN32, DOS, WIN32_AND_DOS = range(4)
#: DC07: which name is the best, by namespace.
RANK = {WIN32: 0, WIN32_AND_DOS: 1, POSIX: 2, DOS: 3}

_HEADER = struct.Struct("<IHHQHHHHIIQH")  # signature, fixup offset and count, lsn, sequence, links, first attribute, flags, used, allocated, base, next id
_ATTRIBUTE = struct.Struct("<IIBBHHH")  # type, length, non-resident, name length, name offset, flags, id
_RESIDENT = struct.Struct("<IHB")
_RUNS = struct.Struct("<QQHHIQQQ")  # lowest and highest vcn, runs offset, compression unit, -, allocated, data, initialised
_TIMES = struct.Struct("<QQQQI")
_NAME = struct.Struct("<QQQQQQQIIBB")
_LIST = struct.Struct("<IHBBQQH")
_BOOT = struct.Struct("<3s8sHB26xQQQbxxxbxxxQ")
_VOLUME = struct.Struct("<QQQQQIIIIQQQQQ")
_JOURNAL = struct.Struct("<QqqqqQQ")
_USN2, _USN3 = struct.Struct("<IHHQQqQIIIIHH"), struct.Struct("<IHHQQQQqQIIIIHH")


def text(raw: bytes) -> str:
    """FN23: UTF-16 with replacement characters for what is no text."""
    return raw.decode("utf-16-le", "replace")


def boot_sector(raw: bytes) -> dict | None:
    """SC13: the geometry of a valid boot sector."""
    if len(raw) < 0x50:
        return None
    _, oem, sector, per_cluster, sectors, mft, mirror, record, index, serial = _BOOT.unpack_from(raw)
    if oem != b"NTFS    " or sector < 256 or sector & (sector - 1) or not per_cluster or per_cluster & (per_cluster - 1):
        return None
    cluster = sector * per_cluster
    return {"bytes_per_sector": sector, "bytes_per_cluster": cluster, "bytes_per_record": 1 << -record if record < 0 else record * cluster, "total_sectors": sectors, "mft_lcn": mft, "mirror_lcn": mirror, "index_clusters": index, "serial": serial, "total_clusters": sectors // per_cluster}


def volume_data(raw: bytes) -> dict | None:
    """SC14: geometry as the system reports it, with the MFT's place and size in records."""
    if len(raw) < 0x60:
        return None
    names = ["serial", "sectors", "total_clusters", "free_clusters", "reserved", "bytes_per_sector", "bytes_per_cluster", "bytes_per_record", "clusters_per_record", "mft_bytes", "mft_lcn", "mirror_lcn", "zone_start", "zone_end"]
    found = dict(zip(names, _VOLUME.unpack_from(raw), strict=True))
    return found | {"mft_offset": found["mft_lcn"] * found["bytes_per_cluster"], "estimated_records": found["mft_bytes"] // max(1, found["bytes_per_record"])}


def journal_data(raw: bytes) -> dict | None:
    """SC15"""
    if len(raw) < _JOURNAL.size:
        return None
    return dict(zip(["journal_id", "first_usn", "next_usn", "lowest_usn", "max_usn", "maximum_size", "allocation_delta"], _JOURNAL.unpack_from(raw), strict=True))


def decode_runs(raw: bytes) -> list[tuple[int, int, bool]]:
    """DC11: (clusters, lcn, sparse) of each run. An lcn is absolute; a run without one is sparse."""
    runs, at, lcn = [], 0, 0
    while at < len(raw) and raw[at]:
        count_size, delta_size = raw[at] & 15, raw[at] >> 4
        end = at + 1 + count_size + delta_size
        if not 1 <= count_size <= 8 or delta_size > 8 or end > len(raw):
            break
        count = int.from_bytes(raw[at + 1 : at + 1 + count_size], "little")
        lcn += int.from_bytes(raw[at + 1 + count_size : end], "little", signed=True)
        runs.append((count, lcn if delta_size else 0, not delta_size))
        at = end
    return runs


def encode_runs(runs: list[tuple[int, int, bool]]) -> bytes:
    out, lcn = b"", 0
    for count, at, sparse in runs:
        n = max(1, (count.bit_length() + 7) // 8)
        delta = b"" if sparse else (at - lcn).to_bytes(((at - lcn if at >= lcn else lcn - at - 1).bit_length() + 8) // 8, "little", signed=True)
        out += bytes([n | len(delta) << 4]) + count.to_bytes(n, "little") + delta
        lcn = lcn if sparse else at
    return out + b"\0"


def fix_up(raw: bytes, offset: int, count: int) -> bytes | None:
    """DC02: the record with its sectors' last bytes put back; None if they don't bear the record's mark."""
    if count < 1 or offset + 2 * count > len(raw):
        return None
    out, mark = bytearray(raw), raw[offset : offset + 2]
    for i in range(1, count):
        end = i * SECTOR
        if end > len(raw):
            break
        if raw[end - 2 : end] != mark:
            return None
        out[end - 2 : end] = raw[offset + 2 * i : offset + 2 * i + 2]
    return bytes(out)


@dataclass(slots=True)
class Entry:
    """DC03: one decoded record."""

    sequence: int = 0
    base_record: int = 0
    in_use: bool = False
    is_directory: bool = False
    name: str = ""
    parent: int = 0
    file_size: int = 0
    allocated_size: int = 0
    attributes: int = 0
    created: int = 0
    modified: int = 0
    links: list[tuple[int, str, int]] = field(default_factory=list)
    runs: list[tuple[int, int, bool]] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)
    name_records: list[int] = field(default_factory=list)
    data_record: int | None = None
    has_data: bool = False
    error: str | None = None


def _attributes(raw: bytes, at: int):
    """DC04: (type, resident, stream name, attribute bytes) of each attribute up to the end mark."""
    while at + _ATTRIBUTE.size <= len(raw):
        kind, length, outside, name_length, name_at, _, _ = _ATTRIBUTE.unpack_from(raw, at)
        if kind == END or not length or at + length > len(raw):
            return
        body = raw[at : at + length]
        name = text(body[name_at : name_at + 2 * name_length]) if name_length and name_at + 2 * name_length <= length else ""
        yield kind, not outside, name, body
        at += length


def _value(body: bytes) -> bytes | None:
    """The value of a resident attribute."""
    if len(body) < 24:
        return None
    size, at, _ = _RESIDENT.unpack_from(body, 16)
    return body[at : at + size] if at + size <= len(body) else None


def _data(entry: Entry, resident: bool, stream: str, body: bytes) -> None:
    """DC10, DC15: a later extent of the same data says nothing new."""
    if resident:
        size, allocated, runs = (_RESIDENT.unpack_from(body, 16)[0] if len(body) >= 24 else None), 0, []
    elif len(body) >= 64:
        lowest, _, runs_at, _, _, allocated, size, _ = _RUNS.unpack_from(body, 16)
        if lowest:
            return
        runs = decode_runs(body[runs_at:])
    else:
        size = None
    if size is None:
        return
    if stream:
        entry.streams[stream] = size
    else:
        entry.file_size, entry.allocated_size, entry.runs, entry.has_data = size, allocated, runs, True


def mft_record(raw: bytes, record: int) -> Entry:
    """DC01-DC12. What can't be read is an entry with an error and nothing else."""
    if len(raw) < 48:
        return Entry(error="short record")
    signature, fix_at, fix_count, _, sequence, _, first, flags, _, _, base, _ = _HEADER.unpack_from(raw)
    if signature != FILE_SIGNATURE:
        return Entry(error="bad signature")
    if (whole := fix_up(raw, fix_at, fix_count)) is None:
        return Entry(error="fixup mismatch")
    e = Entry(sequence=sequence, base_record=base & RECORD_MASK, in_use=bool(flags & 1), is_directory=bool(flags & 2))
    if not e.in_use:
        return e
    best: tuple | None = None
    for kind, resident, stream, body in _attributes(whole, first):
        value = _value(body) if resident else None
        if kind == STANDARD_INFORMATION and value and len(value) >= 48:
            e.created, e.modified, _, _, e.attributes = _TIMES.unpack_from(value)
            e.is_directory |= bool(e.attributes & 0x10)
        elif kind == FILE_NAME and value and len(value) >= _NAME.size:
            parent, created, modified, *_, length, space = _NAME.unpack_from(value)
            if space in RANK and _NAME.size + 2 * length <= len(value):
                name = text(value[_NAME.size : _NAME.size + 2 * length])
                if space != DOS:
                    e.links.append((parent & RECORD_MASK, name, space))
                if best is None or RANK[space] < RANK[best[0]]:
                    best = (space, name, parent & RECORD_MASK, created, modified)
        elif kind == DATA:
            _data(e, resident, stream, body)
        elif kind == ATTRIBUTE_LIST and value:
            for wanted, vcn, name_length, other in list_entries(value):
                if other == record:
                    continue
                if wanted == FILE_NAME and other not in e.name_records:
                    e.name_records.append(other)
                if wanted == DATA and not vcn and not name_length and e.data_record is None:
                    e.data_record = other
    if best:
        _, e.name, e.parent, created, modified = best
        e.created, e.modified = e.created or created, e.modified or modified  # DC09
    return e


def parent_info(raw: bytes) -> tuple[int, str] | None:
    """DC17: parent and best name of a record whose sectors' ends are in place; None for what is unused, no record, or without a name."""
    if len(raw) < 48:
        return None
    signature, _, _, _, _, _, first, flags, *_ = _HEADER.unpack_from(raw)
    if signature != FILE_SIGNATURE or not flags & 1:
        return None
    names = []
    for kind, resident, _, body in _attributes(raw, first):
        value = _value(body) if kind == FILE_NAME and resident else None
        if value and len(value) >= _NAME.size:
            parent, *_, length, space = _NAME.unpack_from(value)
            if space in RANK and _NAME.size + 2 * length <= len(value):
                names.append((RANK[space], parent & RECORD_MASK, text(value[_NAME.size : _NAME.size + 2 * length])))
    return min(names, key=lambda n: n[0])[1:] if names else None


def list_entries(raw: bytes):
    """DC12: (attribute type, lowest vcn, name length, record) of each entry."""
    at = 0
    while at + _LIST.size <= len(raw):
        kind, length, name_length, _, vcn, reference, _ = _LIST.unpack_from(raw, at)
        if not kind or length < _LIST.size:
            return
        yield kind, vcn, name_length, reference & RECORD_MASK
        at += length


def usn_record(raw: bytes) -> dict | None:
    """DC18: versions 2 and 3; of 128-bit references the low half counts."""
    if len(raw) < 8:
        return None
    length, major = struct.unpack_from("<IH", raw)
    layout = _USN3 if major >= 3 else _USN2
    if len(raw) < layout.size:
        return None
    values = layout.unpack_from(raw)
    reference, parent = (values[3], values[5]) if major >= 3 else (values[3], values[4])
    usn, timestamp, reason, source, security, attributes, size, at = values[-8:]
    if at + size > min(len(raw), length):
        return None
    return {"record_number": reference & RECORD_MASK, "parent_record_number": parent & RECORD_MASK, "file_reference_number": reference, "usn": usn, "timestamp": timestamp, "reason_bits": reason, "source_info": source, "security_id": security, "attributes": attributes, "name": text(raw[at : at + size])}


def usn_page(raw: bytes) -> tuple[int | None, list[dict]]:
    """SC07: the cursor that a page ends with, and its records. A record of under 60 bytes, or over 64 KB, ends the page."""
    if len(raw) < 8:
        return None, []
    found, at = [], 8
    while at + 4 <= len(raw):
        (length,) = struct.unpack_from("<I", raw, at)
        if not 60 <= length <= 65536 or at + length > len(raw):
            break
        if (record := usn_record(raw[at : at + length])) is not None:
            found.append(record)
        at += length
    return struct.unpack_from("<Q", raw)[0], found


# --- the encoder ------------------------------------------------------------------------------------------------------------


def pack_attribute(kind: int, value: bytes = b"", stream: str = "", runs: list | None = None, size: int = 0, allocated: int = 0, lowest: int = 0) -> bytes:
    name = stream.encode("utf-16-le")
    head = 24 if runs is None else 64
    at = (head + len(name) + 7) // 8 * 8
    body = value if runs is None else encode_runs(runs)
    length = (at + len(body) + 7) // 8 * 8
    out = _ATTRIBUTE.pack(kind, length, runs is not None, len(stream), head, 0, 0)
    out += _RESIDENT.pack(len(value), at, 0) + b"\0" if runs is None else _RUNS.pack(lowest, 0, at, 0, 0, allocated, size, size)
    return ((out + name).ljust(at, b"\0") + body).ljust(length, b"\0")


def pack_times(created: int, modified: int, attributes: int) -> bytes:
    return pack_attribute(STANDARD_INFORMATION, _TIMES.pack(created, modified, 0, 0, attributes).ljust(48, b"\0"))


def pack_name(parent: int, name: str, space: int = WIN32, created: int = 0, modified: int = 0) -> bytes:
    raw = name.encode("utf-16-le", "surrogatepass")
    return pack_attribute(FILE_NAME, _NAME.pack(parent, created, modified, 0, 0, 0, 0, 0, 0, len(raw) // 2, space) + raw)


def pack_list(entries: list[tuple[int, int, int]]) -> bytes:
    """entries: (attribute type, lowest vcn, record)."""
    return pack_attribute(ATTRIBUTE_LIST, b"".join(_LIST.pack(kind, 32, 0, 26, vcn, record, 0).ljust(32, b"\0") for kind, vcn, record in entries))


def pack_record(attributes: list[bytes], sequence: int = 1, in_use: bool = True, directory: bool = False, base: int = 0, size: int = 1024, links: int = 1, signature: int = FILE_SIGNATURE, number: int = 0) -> bytes:
    sectors = size // SECTOR
    first = (48 + 2 * (sectors + 1) + 7) // 8 * 8
    body = b"".join(attributes) + struct.pack("<II", END, 0)
    out = bytearray(_HEADER.pack(signature, 48, sectors + 1, 0, sequence, links, first, in_use | directory << 1, first + len(body), size, base, 0).ljust(first, b"\0") + body)
    out[44:48] = struct.pack("<I", number & 0xFFFFFFFF)
    if len(out) > size:
        raise ValueError("the attributes don't fit")
    out = out.ljust(size, b"\0")
    out[48:50] = mark = b"\x07\x00"
    for i in range(1, sectors + 1):
        out[48 + 2 * i : 50 + 2 * i] = out[i * SECTOR - 2 : i * SECTOR]
        out[i * SECTOR - 2 : i * SECTOR] = mark
    return bytes(out)


def pack_usn(record: int, parent: int, name: str, usn: int, timestamp: int, reason: int, attributes: int = 32, version: int = 2) -> bytes:
    raw = name.encode("utf-16-le", "surrogatepass")
    layout = _USN3 if version >= 3 else _USN2
    length = (layout.size + len(raw) + 7) // 8 * 8
    references = (record, 0, parent, 0) if version >= 3 else (record, parent)
    return (layout.pack(length, version, 0, *references, usn, timestamp, reason, 0, 0, attributes, len(raw), layout.size) + raw).ljust(length, b"\0")


def pack_volume(**values: int) -> bytes:
    names = ["serial", "sectors", "total_clusters", "free_clusters", "reserved", "bytes_per_sector", "bytes_per_cluster", "bytes_per_record", "clusters_per_record", "mft_bytes", "mft_lcn", "mirror_lcn", "zone_start", "zone_end"]
    return _VOLUME.pack(*[values.get(n, 0) for n in names])


def pack_journal(**values: int) -> bytes:
    return _JOURNAL.pack(*[values.get(n, 0) for n in ["journal_id", "first_usn", "next_usn", "lowest_usn", "max_usn", "maximum_size", "allocation_delta"]])


def pack_boot(sector: int = 512, per_cluster: int = 8, sectors: int = 1 << 20, mft: int = 786432, mirror: int = 2, record: int = -10, index: int = 1, serial: int = 1, oem: bytes = b"NTFS    ") -> bytes:
    return _BOOT.pack(b"\xebR\x90", oem, sector, per_cluster, sectors, mft, mirror, record, index, serial).ljust(512, b"\0")
