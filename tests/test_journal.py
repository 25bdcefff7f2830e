from __future__ import annotations

import random

import struct

from pyspark.sql import functions as F

from arbordex.sources import layouts
from arbordex.streaming import journal as j

BITS = [0x100, 0x200, 0x1000, 0x2000, 0x800, 0x8000, 0x1, 0x400, 0x80000400]


def rows(n=200):
    rng = random.Random(3)
    return [("C", rng.randrange(12), rng.randrange(5), f"n{u}", rng.choice(BITS), u % 7, u, u) for u in range(n)]


def state(df):
    return {(r.drive, r.record_number): tuple(r)[2:] for r in df.collect()}


def test_stream_is_batch(spark, tmp_path):
    journal = spark.createDataFrame(rows(), j.JOURNAL)
    for i, (lo, hi) in enumerate([(0, 30), (30, 31), (31, 140), (140, 200)]):
        journal.where(F.col("usn").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    latest: dict = {}

    def keep(batch, _):
        latest.update(state(batch))

    stream = j.read_journal(spark, str(tmp_path / "in" / "*"), 1)
    q = j.apply_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert latest == state(j.fold(journal))


def test_changes_and_positions(spark):
    journal = spark.createDataFrame(rows(50), j.JOURNAL)
    kept = j.changes(journal)
    assert kept.where("reason = 'Other' AND reason_bits < 2147483648").count() == 0
    assert j.next_usn(journal).head().next_usn == 50 and j.since(journal, 40).count() == 10 and j.since(journal, None).count() == 50
    created = j.fold(journal, created_only=True)
    assert created.count() == journal.where("reason_bits = 256").select("record_number").distinct().count()


def pages(folder, found, size):
    folder.mkdir(exist_ok=True)
    for i in range(0, len(found), size):
        part = found[i : i + size]
        records = b"".join(layouts.pack_usn(r, p, n, u, t, bits, a, 2 + u % 2) for _, r, p, n, bits, a, u, t in part)
        (folder / f"{part[0][6]:020d}.bin").write_bytes(struct.pack("<Q", part[-1][6] + 1) + records)


def test_pages_are_polled(spark, tmp_path):
    """A stream of raw pages, from a position or the end on; a restart goes on where it stopped."""
    found = rows()
    pages(tmp_path / "journal", found[:120], 16)
    wanted = lambda least, most: {r[6] for r in found if least <= r[6] < most and r[4] & j.MASK}
    assert {r.usn for r in j.pages(spark, str(tmp_path / "journal"), start=50).collect()} == wanted(50, 120)
    assert j.pages(spark, str(tmp_path / "journal"), mask=0).count() == 120 and j.pages(spark, str(tmp_path / "journal"), start="latest").count() == 0
    got: dict = {}

    def run(name, start):
        batches = got.setdefault(name, [])
        q = j.poll(spark, str(tmp_path / "journal"), start=start, pages=2).writeStream.foreachBatch(lambda b, _: batches.append(sorted(r.usn for r in b.collect()))).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()

    run("all", "earliest")
    run("new", "latest")
    seen = [u for b in got["all"] for u in b]
    assert sorted(seen) == sorted(wanted(0, 120)) and not any(got["new"])
    pages(tmp_path / "journal", found[120:], 16)
    run("all", "earliest")
    run("new", "latest")
    assert sorted(u for b in got["all"] for u in b) == sorted(wanted(0, 200)) and sorted(u for b in got["new"] for u in b) == sorted(wanted(120, 200))
