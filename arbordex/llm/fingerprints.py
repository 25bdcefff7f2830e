"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the shortest piece that isn't in the dictionary yet. The set
of phrases is hashed; the fingerprint is a one-permutation min-hash signature of that set (BINS bins, the
lowest 16 bits of each bin's smallest hash; EMPTY marks a bin without phrases), as base64. The likeness of two
fingerprints is the share of equal bins among those that either fills: an estimate of the Jaccard similarity of the
phrase sets, which is close to 1 where one text compresses well given the other.

Dictionaries of LZ78 are closed under prefixes, so a phrase's length is found by bisection. An edited text that
starts like its original takes over the original's parse up to where they part.

Each document also meets the next by doc_id (after the last: the first). Documents are dealt into ranges of doc_id;
the first of each range is sent to the range before, too, so texts are shuffled once and a
task streams over its range with one text held back.

Null text counts as empty; an empty text has an empty fingerprint, which is like (1.0) another
empty one and unlike (0.0) all others. Null doc_id comes first; equal doc_ids come in the order of their texts.
A single document is its own next. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, shards, texts_of, tune

BINS = 128
EMPTY = 0xFFFF
#: Ranges of doc_id for each shuffle partition, so that hashing ranges to partitions is even.
RANGES = 3
_LOWEST = -(1 << 63)


class Parse:
    """An LZ78 parse that can be wound back to where two texts part."""

    def __init__(self) -> None:
        self.phrases: set[str] = set()
        self.state: tuple[int, int, str] = (0, 2, "")  # the longest phrase, the last one's length, text that waits

    def feed(self, text: str) -> list[str]:
        """The new phrases. A last piece that the dictionary has waits for more text; at the end it adds nothing to the set."""
        longest, usual, waiting = self.state
        text, known, out, at = waiting + text, self.phrases, [], 0
        size = len(text)
        while at < size:
            low, high, guess = 0, min(longest, size - at) + 1, usual  # low: a known length; high: one that is not, or past the end
            while high - low > 1:
                if not low < guess < high:
                    guess = (low + high) >> 1
                if text[at : at + guess] in known:
                    low = guess
                    guess += 1
                else:
                    high = guess
                    guess -= 1
            if at + high > size:
                break
            out.append(text[at : at + high])
            known.add(out[-1])
            at += high
            usual = high
            if high > longest:
                longest = high
        self.state = longest, usual, text[at:]
        return out

    def forget(self, phrases: list[str], state: tuple[int, int, str]) -> None:
        self.phrases.difference_update(phrases)
        self.state = state


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64, n of each at least; kept between calls."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        base = 0xD6E8FEB86659FD93
        _POWERS = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _bins(phrases: list[str], into: np.ndarray | None = None) -> np.ndarray:
    """The smallest hash in each bin. All phrases are hashed at once: polynomials of their code points, mixed."""
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64) if into is None else into.copy()
    if phrases:
        codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
        power, inverse = _powers(len(codes) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(codes + np.uint64(0x632BE59BD9B4E019)) * power[: len(codes)])])
        starts = np.concatenate([[0], ends[:-1]])
        h = _mixed((sums[ends] - sums[starts]) * inverse[starts])
        bins = (h >> np.uint64(57)).astype(np.int64)
        order = np.lexsort((h, bins))
        first = order[np.concatenate([[True], np.diff(bins[order]) != 0])]
        least[bins[first]] = np.minimum(least[bins[first]], h[first])
    return least


def _signature(least: np.ndarray) -> np.ndarray:
    """16 bits for each bin. A hash whose low bits look like EMPTY is moved aside."""
    low = (least & np.uint64(0xFFFF)).astype("<u2")
    return np.where(least == np.iinfo(np.uint64).max, EMPTY, np.where(low == EMPTY, EMPTY - 1, low)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def to_string(signature: np.ndarray) -> str:
    return base64.b64encode(signature.tobytes()).decode("ascii")


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u2")


def fingerprints(text: str, ending: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The signature of text, and of text with its last quarter replaced by ending, parsed from where they part."""
    parse, part = Parse(), len(text) - len(text) // 4
    common = _bins(parse.feed(text[:part]))
    before = parse.state
    own = parse.feed(text[part:])
    signature = _signature(_bins(own, common))
    if ending is None or ending == text[part:]:
        return signature, None if ending is None else signature
    parse.forget(own, before)
    return signature, _signature(_bins(parse.feed(ending), common))


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (part, guest, doc_id, text). A guest is the first of the next range: each range ends with one."""
    held: tuple | None = None  # the last row: part, doc_id, text
    waits: tuple | None = None  # the row before it, whose fingerprint has yet to meet the held one's
    for batch in batches:
        out: list[tuple] = []
        for part, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts_of(batch.column(3)).to_pylist(), strict=True):
            if held:
                before = held[2]
                kept = len(before) - len(before) // 4
                ending = text[: len(before) // 4]
                own, edited = fingerprints(before, ending)
                if waits:
                    out.append((*waits[:-1], likeness(waits[-1], own)))
                digest = hashlib.sha256((before[:kept] + ending).encode("utf-8", "surrogatepass")).hexdigest()
                waits = (held[1], len(before), digest, to_string(own), to_string(edited), likeness(own, edited), own)
            if guest and waits:
                out.append((*waits[:-1], likeness(waits[-1], fingerprints(text)[0])))
            held, waits = (None, None) if guest else ((part, doc_id, text), waits)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_ARROW)], names=SCHEMA.names)


def _part(doc_id, bounds: list[int]):
    """The number of bounds that doc_id reaches, by two short searches."""
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    reached = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    block = reached(F.array(*[F.lit(b[0]).cast("long") for b in blocks])) - 1
    inner = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks]), block + 1)
    return block * width + reached(inner)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (part, guest, doc_id, text): ranges of doc_id, each in order and ended by the first of the next."""
    spark = docs.sparkSession
    n = shards(spark)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("at"))
    cuts = [i / (RANGES * n) for i in range(RANGES * n)]
    found = rows.agg(F.percentile_approx("at", cuts, max(10_000, 20 * len(cuts))).alias("b")).head()["b"]
    bounds = sorted(set(found or [])) or [_LOWEST]
    bounds[0] = _LOWEST
    rows = rows.withColumn("part", _part(F.col("at"), bounds))
    # At most RANGES rows for each shuffle partition come to the driver and are broadcast.
    firsts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min("at").alias("at")).collect())
    guests = spark.createDataFrame([(at, firsts[i - 1][0]) for i, (_, at) in enumerate(firsts)], "guest_at long, guest_part int")
    rows = rows.join(F.broadcast(guests), F.col("at") == F.col("guest_at"), "left")
    both = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("guest_part").alias("part"), F.lit(True).alias("guest")))
    rows = rows.select("doc_id", "text", "at", F.inline(F.when(F.col("guest_part").isNull(), F.slice(both, 1, 1)).otherwise(both)))
    return rows.repartition(n, "part").sortWithinPartitions("part", "guest", "at", "text").select("part", "guest", F.col("doc_id").cast("long").alias("doc_id"), "text")


def compare(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: SCHEMA."""
    tune(docs.sparkSession)
    return with_next(docs).mapInArrow(_meet, SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(documents(spark, sf_dir))
