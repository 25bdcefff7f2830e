"""A Bloom filter of a table's keys, built by the executors: which rows of another table may be wanted.

It has MOST bits at most (so many bytes / 8 are broadcast, whatever the data). A row that passes for no reason is dropped by the join that
follows; when there are far more keys than bits, most rows pass, and only that join still counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, mix, salted

MOST = 1 << 27


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys ^ salted(91))
    return h & U(size - 1), h >> U(32) & U(size - 1)


def sieve(keys: DataFrame, n: int, most: int = MOST) -> np.ndarray:
    """The filter of keys (one long column); n: about how many there are."""
    size = min(most, max(1 << 12, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size >> 6, np.uint64)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(table, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        some = np.flatnonzero(table)
        for i in range(0, len(some), 1 << 16):
            part = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].view(np.int64))], names=["place", "bits"])

    found = keys.mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # MOST / 64 rows at most
    table = np.zeros(size >> 6, np.uint64)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return table


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = _bits(keys, len(table) << 6)
    look = lambda at: table[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)
    return (look(one) & look(two)).astype(bool)
