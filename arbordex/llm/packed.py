"""Rows of numbers that go through a shuffle as one binary value for each batch and shard.

A row in Spark's own format has some 16 bytes besides its numbers; many small rows would cost more disk and
time for that than for what they say. A value holds columns one after the other, each as planes of its bytes
(first the lowest byte of all rows), compressed: high bytes of small or ordered numbers take next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SCHEMA = "shard int, rows binary"


def _partition(x: np.ndarray, n: int) -> np.ndarray:
    """Where repartition(n, int column) sends these numbers: Murmur3 of four bytes, seed 42, as Spark's documentation of hash() has it."""
    turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    h = np.uint32(42) ^ turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % n


@cache
def deal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n partitions a number of 0 or more, and one below 0, that repartition(n, "shard") sends to it: parts are even."""
    found, size = np.zeros(0, np.int64), 16 * n
    while len(found) < n:
        size *= 2
        _, found = np.unique(_partition(np.arange(size), n), return_index=True)
    below, size = np.zeros(0, np.int64), 16 * n
    while len(below) < n:
        size *= 2
        _, below = np.unique(_partition(-1 - np.arange(size), n), return_index=True)
    return found.astype(np.int32), (-1 - below).astype(np.int32)


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def pack(shard: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One binary value for each shard: the number of rows (8 bytes) and the columns, one after the other."""
    codec = pa.Codec("zstd", compression_level=1)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    columns = [c[order] for c in columns]
    cuts = np.concatenate([np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(0, np.int64)
    ids, blobs, at = [], [], 0
    for end in cuts.tolist():
        ids.append(int(shard[at]))
        blobs.append((end - at).to_bytes(8, "little") + codec.compress(b"".join(_planes(c[at:end]) for c in columns), asbytes=True))
        at = end
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "rows"])


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all values together."""
    codec = pa.Codec("zstd")
    widths = [np.dtype(k).itemsize for k in kinds]
    sizes = [int.from_bytes(b[:8], "little") for b in blobs]
    out = [np.empty(sum(sizes), k) for k in kinds]
    at = 0
    for blob, n in zip(blobs, sizes, strict=True):
        data, first = np.frombuffer(codec.decompress(pa.py_buffer(blob)[8:], n * sum(widths), asbytes=True), np.uint8), 0
        for column, width in zip(out, widths, strict=True):
            column[at : at + n].view(np.uint8).reshape(n, width)[:] = data[first : first + n * width].reshape(width, n).T
            first += n * width
        at += n
    return out


def gathered(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> list[np.ndarray]:
    """All rows of a partition. Operators deal rows into as many partitions as their number asks for."""
    return unpack([b for batch in batches for b in batch.column(1).to_pylist()], kinds)
