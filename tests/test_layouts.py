from __future__ import annotations

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbordex.sources import layouts as lay
from arbordex.sources import scan

runs = st.lists(st.one_of(st.tuples(st.integers(1, 1 << 40), st.integers(-(1 << 40), 1 << 40), st.just(False)), st.tuples(st.integers(1, 1 << 40), st.just(0), st.just(True))), max_size=8)


@given(runs)
def test_runs_come_back(found):
    assert lay.decode_runs(lay.encode_runs(found)) == found


@given(st.binary(max_size=64))
def test_any_bytes_decode(raw):
    lay.decode_runs(raw)
    lay.usn_page(raw)
    lay.mft_record(raw, 1)


@settings(max_examples=50)
@given(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=60), st.integers(0, (1 << 48) - 1), st.integers(0, 0xFFFF))
def test_names_come_back(name, parent, sequence):
    e = lay.mft_record(lay.pack_record([lay.pack_name(parent, name)], sequence), 9)
    assert (e.name, e.parent, e.sequence, e.error) == (name, parent, sequence, None)


def test_record_cases():
    good = lay.pack_record([lay.pack_times(0, 3, 0x10), lay.pack_name(5, "N~1", lay.DOS), lay.pack_name(6, "name", lay.WIN32, 1, 2), lay.pack_attribute(lay.DATA, b"xyz"), lay.pack_attribute(lay.DATA, b"12", "side")])
    e = lay.mft_record(good, 40)
    assert (e.name, e.parent, e.created, e.modified, e.is_directory, e.file_size, e.allocated_size, e.streams) == ("name", 6, 1, 3, True, 3, 0, {"side": 2})
    assert e.links == [(6, "name", lay.WIN32)]
    torn = bytearray(good)
    torn[510] ^= 1
    assert lay.mft_record(bytes(torn), 40).error == "fixup mismatch"
    assert lay.mft_record(lay.pack_record([], signature=0x44414142), 1).error == "bad signature"
    assert lay.mft_record(b"", 1).error == "short record"
    assert not lay.mft_record(lay.pack_record([lay.pack_name(5, "x")], in_use=False), 1).in_use
    assert lay.mft_record(lay.pack_record([lay.pack_name(5, "P", lay.POSIX)]), 1).name == "P"
    later = lay.pack_attribute(lay.DATA, runs=[(1, 2, False)], size=9, allocated=9, lowest=4)
    assert not lay.mft_record(lay.pack_record([later]), 1).has_data


def test_journal_records():
    two, three = lay.pack_usn(7, 5, "ä", 1, 2, 0x80000100), lay.pack_usn(8, 5, "b", 3, 4, 1, version=3)
    cursor, found = lay.usn_page(struct.pack("<Q", 99) + two + three)
    assert cursor == 99 and [(r["record_number"], r["name"], r["usn"]) for r in found] == [(7, "ä", 1), (8, "b", 3)]
    assert lay.usn_record(two[:59]) is None
    past = bytearray(two)
    past[56:58] = b"\xff\x00"
    assert lay.usn_record(bytes(past)) is None


def test_geometry():
    good = lay.boot_sector(lay.pack_boot())
    assert (good["bytes_per_record"], good["bytes_per_cluster"], good["mft_lcn"]) == (1024, 4096, 786432)
    assert lay.boot_sector(lay.pack_boot(record=1))["bytes_per_record"] == 4096
    assert lay.boot_sector(lay.pack_boot(oem=b"FAT32   ")) is None and lay.boot_sector(lay.pack_boot(sector=500)) is None
    assert lay.boot_sector(lay.pack_boot(per_cluster=0)) is None and lay.boot_sector(lay.pack_boot()[:0x4F]) is None
    raw = struct.pack("<QQQQQIIIIQQQQQ", 1, 2, 100, 50, 0, 512, 4096, 1024, 0, 10240, 7, 8, 9, 10)
    assert lay.volume_data(raw)["mft_offset"] == 7 * 4096 and lay.volume_data(raw)["estimated_records"] == 10
    assert lay.journal_data(struct.pack("<QqqqqQQ", 1, 2, 3, 4, 5, 6, 7))["next_usn"] == 3


def test_scan_of_an_image(spark, tmp_path):
    records = [lay.pack_record([lay.pack_name(5, ".")], directory=True), lay.pack_record([lay.pack_times(1, 1, 2), lay.pack_name(5, "hidden.txt")]), b"\0" * 1024, lay.pack_record([lay.pack_name(5, "a"), lay.pack_name(6, "b"), lay.pack_name(5, "c")])]
    (tmp_path / "mft.bin").write_bytes(b"head" + b"".join(records) + b"rest")
    config = scan.ScanConfig("C", offset=4, hidden=False)
    raw = scan.image_records(spark, str(tmp_path / "mft.bin"), config)
    found = sorted((r.record_number, r.parent_record_number, r.name) for r in scan.scan(raw, config).collect())
    assert found == [(0, 5, "."), (3, 5, "a"), (3, 5, "c"), (3, 6, "b")]
    strict = scan.nodes_from_entries(scan.resolve_extensions(scan.decode_records(raw)), True).where("record_number = 3")
    assert sorted(r.name for r in strict.collect()) == ["a", "b"]
    rows, errors = scan.scan_any({"bad": lambda: spark.read.parquet(str(tmp_path / "none")), "good": lambda: raw})
    assert rows is raw and list(errors) == ["bad"]


def hexed(text):
    return bytes.fromhex("".join(text.split()))


def test_bytes_written_by_hand():
    """Fixed bytes, typed from the layouts, not from the packer."""
    boot = bytearray(512)
    boot[3:11], boot[0x0B:0x0D], boot[0x0D] = b"NTFS    ", hexed("00 02"), 8
    boot[0x28:0x30], boot[0x30:0x38], boot[0x38:0x40] = hexed("00 00 10 00 00 00 00 00"), hexed("00 00 0C 00 00 00 00 00"), hexed("02 00 00 00 00 00 00 00")
    boot[0x40], boot[0x44], boot[0x48:0x50] = 0xF6, 1, hexed("EF CD AB 89 67 45 23 01")
    found = lay.boot_sector(bytes(boot))
    assert (found["bytes_per_cluster"], found["bytes_per_record"], found["total_sectors"], found["mft_lcn"], found["serial"]) == (4096, 1024, 0x100000, 0xC0000, 0x0123456789ABCDEF)
    record = bytearray(1024)
    record[:48] = hexed("46494C45 3000 0300 0000000000000000 0700 0100 3800 0100 A8010000 00040000 0000000000000000 0300 0000 2A000000")
    record[48:54] = hexed("0500 0000 0000")  # the mark, and what stood in its two places
    times = hexed("10000000 60000000 00 00 0000 0000 0000 48000000 1800 00 00") + hexed("0100000000000000 0200000000000000 0300000000000000 0400000000000000 20000000") + bytes(36)
    name = hexed("30000000 70000000 00 00 0000 0000 0100 52000000 1800 01 00") + hexed("0500000000000500") + hexed("0B00000000000000 0C00000000000000") + bytes(16) + bytes(16) + hexed("20000000 00000000 08 01") + "file.txt".encode("utf-16-le")
    data = hexed("80000000 48000000 01 00 0000 0000 0200") + hexed("0000000000000000 0700000000000000 4000 0000 00000000 0080000000000000 3412000000000000 3412000000000000") + hexed("21 08 34 56 00 000000")
    body = times.ljust(0x60, b"\0") + name.ljust(0x70, b"\0") + data.ljust(0x48, b"\0") + hexed("FFFFFFFF")
    record[56 : 56 + len(body)] = body
    record[510:512] = record[1022:1024] = hexed("0500")
    e = lay.mft_record(bytes(record), 42)
    assert (e.error, e.sequence, e.in_use, e.is_directory, e.name, e.parent) == (None, 7, True, False, "file.txt", 5)
    assert (e.created, e.modified, e.attributes, e.file_size, e.allocated_size, e.runs) == (1, 2, 32, 0x1234, 0x8000, [(8, 0x5634, False)])
    assert lay.parent_info(bytes(record)) == (5, "file.txt")
    two = hexed("48000000 0200 0000 2A00000000000100 0500000000000500 1027000000000000 0100000000000000 00010080 00000000 00000000 20000000 0800 3C00") + "a.md".encode("utf-16-le")
    three = hexed("54000000 0300 0000 2A000000000001000000000000000000 05000000000005000000000000000000 1127000000000000 0100000000000000 00020080 00000000 00000000 20000000 0800 4C00") + "b.md".encode("utf-16-le")
    cursor, found = lay.usn_page(hexed("1227000000000000") + two.ljust(0x48, b"\0") + three.ljust(0x54, b"\0"))
    assert cursor == 0x2712 and [(r["record_number"], r["parent_record_number"], r["usn"], r["reason_bits"], r["name"]) for r in found] == [(42, 5, 0x2710, 0x80000100, "a.md"), (42, 5, 0x2711, 0x80000200, "b.md")]


def test_parent_info():
    good = lay.pack_record([lay.pack_name(9, "N~1", lay.DOS), lay.pack_name(7, "posix", lay.POSIX), lay.pack_name(8, "both", lay.WIN32_AND_DOS), lay.pack_name(6, "win", lay.WIN32)])
    assert lay.parent_info(good) == (6, "win")
    assert lay.parent_info(lay.pack_record([lay.pack_name(6, "x")], in_use=False)) is None and lay.parent_info(lay.pack_record([])) is None
    assert lay.parent_info(b"") is None and lay.parent_info(lay.pack_record([lay.pack_name(6, "x")], signature=1)) is None


@pytest.mark.parametrize("split", [3, 1 << 16])
def test_volume_images(spark, tmp_path, split):
    """Three extents out of order, one of which ends within a record; every partitioning gives the same records."""
    records = [lay.pack_record([lay.pack_name(5, f"n{i}")], number=i) for i in range(1, 40)]
    runs = [(15, 300, False), (30, 10, False), (35, 100, False)]
    own = lay.pack_record([lay.pack_attribute(lay.DATA, runs=runs, size=40 * 1024, allocated=80 * 512)])
    table, image, at = own + b"".join(records), bytearray(b"\xAA" * 512 * 400), 0
    for n, lcn, _ in runs:
        image[512 * (3 + lcn) : 512 * (3 + lcn + n)] = table[512 * at : 512 * (at + n)]
        at += n
    image[512 * 3 : 512 * 4] = lay.pack_boot(512, 1, 400, 300)
    path = str(tmp_path / "volume.img")
    (tmp_path / "volume.img").write_bytes(bytes(image))
    config = scan.ScanConfig("V", offset=512 * 3)
    raw = scan.image_records(spark, path, config, "volume", split=split)
    assert {(r.drive, r.record_number): bytes(r.data) for r in raw.collect()} == {("V", i): x for i, x in enumerate([own, *records])}
    assert raw.rdd.getNumPartitions() >= {3: 14}.get(split, 3)
    two = scan.checked(scan.image_records(spark, path, config, "volume", [7, 8], split))
    assert sorted((r.record_number, bytes(r.data), r.is_wanted) for r in two.collect()) == [(7, records[6], True), (8, records[7], True)]
    with pytest.raises(Exception, match="short read"):
        scan.image_records(spark, path, config, "volume", [40]).collect()
    wrong = spark.createDataFrame([("V", 3, lay.pack_record([], number=4)), ("V", 5, lay.pack_record([]))], "drive string, record_number long, data binary")
    assert [r.is_wanted for r in scan.checked(wrong).orderBy("record_number").collect()] == [False, True]
    found, errors = scan.scan_drives({"V": lambda: raw, "X": lambda: scan.image_records(spark, path, config, "volume", [99])})
    assert found.count() == 39 and errors["V"] is None and "short read" in errors["X"] and {r.drive for r in found.collect()} == {"V"}


def test_presets(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Name,Case,Whole Word,Path,Diacritics,Regex,Search,Macro,Key\n"ALL",0,0,0,0,0,"",,\n"EXE",0,0,0,1,0,"ext:bat;exe","exe",\n"short",0\n"",0,0,0,0,0,"x",,\n')
    assert sorted(tuple(r) for r in scan.read_presets(spark, str(tmp_path / "f.csv")).collect()) == [("ALL", "", ""), ("EXE", "ext:bat;exe", "exe")]
    assert scan.preset_line('"A",0,0,0,0,0,"s"') == {"name": "A", "search": "s", "macro": ""}


def _counted(spark, rows):
    """rows of raw records, and how many of them were made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, scan.RAW).mapInArrow(run, scan.RAW), made


def test_scan_decodes_once(spark):
    """dc13_extensions: bases with names in two extensions, of which one holds the data, too; a listed record that isn't there."""
    rows = []
    for n in range(100, 130, 3):
        listed = lay.pack_list([(lay.FILE_NAME, 0, n + 1), (lay.FILE_NAME, 0, n + 2), (lay.DATA, 0, n + 2), (lay.FILE_NAME, 0, 9999)])
        data = lay.pack_attribute(lay.DATA, runs=[(1, 5, False)], size=n, allocated=4096)
        rows += [("C", n, lay.pack_record([listed])), ("C", n + 1, lay.pack_record([lay.pack_name(6, f"a{n}")], base=n)), ("C", n + 2, lay.pack_record([lay.pack_name(7, f"b{n}"), lay.pack_name(8, f"ä{n}"), data], base=n))]
    raw, made = _counted(spark, rows)
    found = sorted((r.record_number, r.parent_record_number, r.name, r.file_size, r.allocated_size, r.source) for r in scan.scan(raw).collect())
    assert found == sorted((n, p, f"{c}{n}", n, 4096, s) for n in range(100, 130, 3) for p, c, s in ((6, "a", "mft"), (7, "b", "link"), (8, "ä", "link")))
    assert made.value == len(rows)


def test_drives_are_made_once(spark):
    """sc20_drives: counting all drives' rows decodes nothing again and joins no drives."""
    one, made_one = _counted(spark, [("C", n, lay.pack_record([lay.pack_name(5, f"c{n}")])) for n in range(50)])
    two, made_two = _counted(spark, [("C", n, lay.pack_record([lay.pack_name(5, f"d{n}"), lay.pack_name(6, f"e{n}")])) for n in range(50)])
    found, errors = scan.scan_drives({"C": lambda: one, "D": lambda: two, "X": lambda: spark.read.parquet("/none")})
    before = made_one.value, made_two.value
    assert {r["drive"]: r["count"] for r in found.groupBy("drive").count().collect()} == {"C": 50, "D": 100}
    assert (made_one.value, made_two.value) == before and errors["C"] is errors["D"] is None and errors["X"]
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
