"""Line dedup by an exact set-similarity join.

A line's set holds its distinct words ``[^\\x20\\x09-\\x0D]+``; lines are what ``\\n`` separates. Two lines match when the Jaccard
similarity of their sets is PERCENT or more. A line that matches an earlier one (by doc_id, then place) is removed; lines are
judged on the input. Lines without words stay.

1. Rarity. Words are counted over the whole corpus in BUCKETS buckets of their hash. A line's words are ordered by their
   bucket's count, then by hash: rare words first.
2. Prefix. Lines that match share one of the first size - ceil(PERCENT * size) + 1 words of each. Only these go to the join, in
   as many parts as their number asks for; those of a word that occurs over HOT times are dealt by size, too.
   Lines with the same set (64 bits of hash, 128 of the bitmap, size) are one from then on: all but the first are removed.
3. Filters. Of the lines that share a prefix word, only pairs whose sizes, whose places of the word (as many words must be left
   as have to be common) and whose parity bitmaps (their distance is at most the symmetric difference) allow a match go on.
4. Verify. The pairs' lines are compared word by word. Texts don't move for that: a filter of bounded size (sieve.py) tells each
   task which lines are wanted, and these alone meet their pairs.

A line needs one earlier match only. So it first meets the FEW likeliest candidates of each prefix word; lines of which none is
verified and that had more are open, and only they meet all of them. No match is lost, and a word that copies of
a line share doesn't bring all their pairs. Filters of the open lines and of their words keep what is sent again small.

Null text is empty. Null doc_id comes before all others. Rows with the same doc_id are told apart by their texts. Rows that repeat
(same doc_id, or both null, and same text) meet other lines as one row; what stays of it stays in one copy, the others keep only
their lines without words. Columns of any names are kept, but for n_lines and n_removed, which are replaced. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import SCHEMA, deal, pack, unpack
from .shared import documents, free, row_key, shards, tune, written
from .sieve import passes, sieve
from .words import U, hashed, heads, mix, pieces, raw, salted, split

PERCENT = 80
BUCKETS = 1 << 20
FEW = 4
#: Neighbours that a line with a large choice looks at first.
NEAR = 64
#: Words that a task gathers before it sends them, and words for each part of the join.
GATHER, PART = 1 << 17, 1 << 19
#: Parts that word counts are added up in.
SLICES = 16
#: Occurrences from which on a word's lines are dealt by size.
HOT = 1 << 24
#: Repeated rows up to which they are broadcast.
REPEATS = 10_000
_BLOCK = 1 << 18
_GONE = ["<i8", "<i8", "<i4"]  # doc, row, line
_PREFIX = ["<u4", "<u8", "<u8", "<u8", "<i8", "<i8", "<i4", "<i4", "<i4"]  # word, set, bitmap (2), doc, row, line, size, place
_MET = "kind int, doc long, row long, line int, doc2 long, row2 long, line2 int, word long"
_IS_GONE, _IS_PAIR, _IS_MORE = range(3)  # a line that is removed; a pair; a pair of a line that has more of them for this word
_LATER, _FORMER = ("doc", "row", "line"), ("doc2", "row2", "line2")
_NULL = -(1 << 63)


def _counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How often the words of each bucket occur, and the number of lines. Tasks send their counts packed, by SLICES slices of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lines = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for lo, hi, part in pieces(batch.column(0)):
                data, offsets = raw(part)
                found, n = np.unique((hashed(data, *split(data, offsets)) & U(BUCKETS - 1)).astype(np.int32), return_counts=True)
                total[found] += n
                lines += hi - lo + int((data == 10).sum())
        some = np.append(np.flatnonzero(total), BUCKETS).astype(np.int32)  # the last one counts lines
        yield pack(deal(SLICES)[0][some % SLICES], [some, np.append(total[some[:-1]], lines)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                bucket, n = unpack([blob], ["<i4", "<i8"])
                total[bucket] += n  # a task has each bucket once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = np.zeros(BUCKETS + 1, np.int64)
    sums = texts.select("text").mapInArrow(run, SCHEMA).repartition(SLICES, "shard").mapInArrow(add, "bucket int, n long").toArrow()  # BUCKETS rows at most
    np.add.at(found, sums.column(0).to_numpy(), sums.column(1).to_numpy())
    return found[:-1], int(found[-1])


def _ordered(line: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by line, then word."""
    if len(line) and line[-1] < 1 << 20:  # lines go up: one number holds a line and most of a word
        key = line.astype(np.uint64) << U(44) | word >> U(20)
        order = np.argsort(key)
        if not ((np.diff(key[order]) == 0) & (np.diff(word[order]) != 0)).any():
            return order
    return np.lexsort((word, line))


def lines_of(texts: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lines with words, in order: text, line number, size, set, bitmap; and their words, rare ones first, with the line's index."""
    data, offsets = raw(texts)
    breaks = np.flatnonzero(data == 10)
    starts, ends = split(data, offsets)
    h = hashed(data, starts, ends)
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    line = np.searchsorted(breaks, starts) + text  # numbers go up by one from a text to the next, too
    word = rank[(h & U(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << U(44) | h >> U(20)
    order = _ordered(line, word)
    word, line, text = word[order], line[order], text[order]
    new = heads(word, line)
    word, line, text = word[new], line[new], text[new]
    first = np.flatnonzero(heads(line))
    size = np.diff(np.concatenate([first, [len(line)]]))
    sums = lambda x, f: f.reduceat(x, first) if len(first) else np.zeros(0, np.uint64)
    set_ = mix(sums(mix(word ^ salted(51)), np.add) + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    spot = mix(word ^ salted(52))
    bit = U(1) << (spot & U(63))
    half = (spot >> U(6) & U(1)).astype(bool)
    maps = sums(np.where(half, bit, U(0)), np.bitwise_xor), sums(np.where(half, U(0), bit), np.bitwise_xor)
    number = line[first] - text[first] - np.searchsorted(breaks, offsets[:-1])[text[first]]
    return text[first], number.astype(np.int32), size.astype(np.int32), set_, *maps, word, np.repeat(np.arange(len(first)), size), first


def _prefixes(size: np.ndarray, percent: int) -> np.ndarray:
    """How many words of a line go to the join."""
    return size - -(-percent * size.astype(np.int64) // 100) + 1


def _keys(doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of lines."""
    return mix(mix(mix(doc.astype(np.int64).view(np.uint64) + salted(92)) ^ row.astype(np.int64).view(np.uint64)) + line.astype(np.uint64))


def _earlier(doc, row, line, x, y) -> np.ndarray:
    """Whether lines x come before lines y."""
    return (doc[x] < doc[y]) | (doc[x] == doc[y]) & ((line[x] < line[y]) | (line[x] == line[y]) & (row[x] < row[y]))


def _classes(key, set_, map_a, map_b, size, doc, row, line) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines by key (32 bits) and set, the first of each set first: their order, whether each is the first, and the first of each."""
    short = key.astype(np.uint64) << U(32) | set_ >> U(32)
    order = np.argsort(short)
    new = heads(short[order])
    several = np.flatnonzero(~new | np.append(~new[1:], False)) if len(order) else order
    some = order[several]  # rows whose short keys agree; few, so only these are ordered by everything
    order[several] = some[np.lexsort((row[some], line[some], doc[some], size[some], map_b[some], map_a[some], set_[some], short[some]))]
    new = heads(*(c[order] for c in (short, set_, map_a, map_b, size)))
    return order, new, order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order


def _word_keys(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """What a filter knows a word by: 32 bits of its key, and the part that it is dealt to."""
    return key.astype(np.uint64) << U(32) | tag.astype(np.int64).view(np.uint64) & U(0xFFFFFFFF)


def _sent(texts: DataFrame, rank: np.ndarray, hot: int, n: int, percent: int, only: np.ndarray | None = None) -> DataFrame:
    """texts: doc, row, text. Words whose rank is hot or more are dealt by size, too. only: the filter of the words to send."""
    shared = texts.sparkSession.sparkContext.broadcast((rank, only))  # BUCKETS numbers, and a filter of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, only = shared.value
        to, to_gone = deal(n)
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            doc, row, line, size, set_, map_a, map_b, key, tag, place = (np.concatenate([x[i] for x in held]) for i in range(10))
            of = np.concatenate([x[10] + b for x, b in zip(held, base, strict=False)])
            held.clear()
            order, new, of_first = _classes(np.zeros(len(doc), np.uint32), set_, map_a, map_b, size, doc, row, line)
            again, of_first = order[~new], of_first[~new]
            twin = (doc[again] == doc[of_first]) & (row[again] == row[of_first]) & (line[again] == line[of_first])
            gone = again[~twin]  # the first line itself, in a repeated row, stays in one copy
            if len(gone) and only is None:
                yield pack(to_gone[(mix(doc[gone].view(np.uint64)) % U(n)).astype(np.int64)], [doc[gone], row[gone], line[gone]])
            once = np.ones(len(doc), bool)
            once[again] = False
            pick = once[of]
            of = of[pick]
            if len(of):
                yield pack(tag[pick], [key[pick], set_[of], map_a[of], map_b[of], doc[of], row[of], line[of], size[of], place[pick]])

        waiting = 0
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, part in pieces(batch.column(2)):
                text, line, size, set_, map_a, map_b, word, of, first = lines_of(part, rank)
                place = (np.arange(len(word)) - first[of]).astype(np.int32)
                pick = place < _prefixes(size, percent)[of]
                of, word, place = of[pick], word[pick], place[pick]
                key, split_ = mix(word), word >> U(44) >= U(hot)
                if split_.any():  # a hot word's lines of two neighbouring bands of sizes meet; no match is further apart
                    band = (np.log(size[of[split_]]) / np.log(100 / percent) + 1e-9).astype(np.uint64)
                    key[split_] = mix(word[split_] + band * U(0x9E3779B97F4A7C15))
                    key = np.concatenate([key, mix(word[split_] + (band + U(1)) * U(0x9E3779B97F4A7C15))])
                    of, place = (np.concatenate([c, c[split_]]) for c in (of, place))
                tag, key = to[(key % U(n)).astype(np.int64)], (key >> U(32)).astype(np.uint32)
                if only is not None:
                    pick = passes(only, _word_keys(key, tag))
                    of, key, tag, place = of[pick], key[pick], tag[pick], place[pick]
                if len(of):
                    held.append((ids[lo:hi][text], rows[lo:hi][text], line, size, set_, map_a, map_b, key, tag, place, of))
                    waiting += len(of)
                if waiting >= GATHER:
                    yield from flush()
                    waiting = 0
        yield from flush()

    return texts.select("doc", "row", "text").mapInArrow(run, SCHEMA)


def _pairs(group, map_a, map_b, doc, row, line, size, place, probe, percent: int, few: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted by group (a word's number) and size: pairs (later, earlier, whether there are more of the later line) that the filters let
    through: the likeliest few of each later line, or all."""
    s = size.astype(np.int64)
    group = group.astype(np.int64) << 40
    # A partner's size is at least PERCENT of a line's own, and at most what the words left after the place allow to be common.
    low = np.searchsorted(group | s, group | -(-percent * s // 100))
    high = np.searchsorted(group | s, group | np.maximum(0, ((100 + percent) * (s - place) - percent * s) // percent), "right")
    room = s - place

    def ranges(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of about _BLOCK pairs: whole lines, or a part of one line's range."""
        width = np.maximum(end - first, 0)
        sums, at = np.cumsum(width), 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(sums, sums[at] - width[at] + _BLOCK, "right")))
            for k in range(0, max(1, int(width[at])), _BLOCK) if to == at + 1 else (0,):
                f = first[at:to] + k
                yield x[at:to], f, np.minimum(width[at:to] - k, _BLOCK)
            at = to

    def met(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of each x with first..end: x, y and their bitmaps' distance."""
        for x_, first_, n in ranges(x, first, end):
            xs = np.repeat(x_, n)
            ys = np.repeat(first_ - np.cumsum(n) + n, n) + np.arange(n.sum())
            keep = (100 + percent) * room[ys] >= percent * (s[xs] + s[ys])
            xs, ys = xs[keep], ys[keep]
            keep = _earlier(doc, row, line, ys, xs)
            xs, ys = xs[keep], ys[keep]
            apart = np.bitwise_count(map_a[xs] ^ map_a[ys]).astype(np.int64) + np.bitwise_count(map_b[xs] ^ map_b[ys])
            both = s[xs] + s[ys]
            keep = apart <= both - 2 * -(-percent * both // (100 + percent))
            yield xs[keep], ys[keep], apart[keep]

    x = np.flatnonzero(probe & (high > low))
    if few is None:
        for xs, ys, _ in met(x, low[x], high[x]):
            yield xs, ys, np.zeros(len(xs), bool)
        return
    more = np.zeros(len(group), bool)

    def nearest(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        x, y, apart = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((y, apart, x))
        x, y, apart = x[order], y[order], apart[order]
        first = np.flatnonzero(heads(x))
        nth = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate([first, [len(x)]])))
        more[x[nth >= few]] = True
        return x[nth < few], y[nth < few], apart[nth < few]

    large = x[(high - low)[x] > NEAR]
    near = nearest([nearest([part]) for part in met(large, np.maximum(low[large], large - NEAR), np.minimum(high[large], large))])
    done = np.bincount(near[0], minlength=len(group)) >= max(1, few)
    more |= done
    x = x[~done[x]]
    x, y, _ = nearest([tuple(c[done[near[0]]] for c in near), *(nearest([part]) for part in met(x, low[x], high[x]))])
    yield x, y, more[x]


def _meet(percent: int, few: int | None, open_: np.ndarray | None):
    """A part of the join. open_: the filter of the lines that look for earlier ones; None: all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, blobs, tags = [], [], []
        for batch in batches:
            for tag, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (gone if tag < 0 else blobs).append(rows)
                if tag >= 0:
                    tags.append((tag, int.from_bytes(rows[:8], "little")))

        def out(kind, doc, row, line, doc2=None, row2=None, line2=None, word=None) -> pa.RecordBatch:
            k = len(doc)
            zero = np.zeros(k, np.int64)
            columns = [np.broadcast_to(np.asarray(kind, np.int32), k), doc, row, line, zero if doc2 is None else doc2, zero if row2 is None else row2, zero.astype(np.int32) if line2 is None else line2, zero if word is None else word]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["kind", "doc", "row", "line", "doc2", "row2", "line2", "word"])

        doc, row, line = unpack(gone, _GONE)
        if len(doc):
            yield out(_IS_GONE, doc, row, line)
        if not blobs:
            return
        tag = np.repeat(*(np.array(c) for c in zip(*tags, strict=True)))
        key, set_, map_a, map_b, doc, row, line, size, place = unpack(blobs, _PREFIX)
        blobs.clear()
        order, new, of_first = _classes(key, set_, map_a, map_b, size, doc, row, line)
        twin = (doc[order] == doc[of_first]) & (row[order] == row[of_first]) & (line[order] == line[of_first])
        again = order[~new & ~twin & (place[order] == 0)]
        if len(again) and open_ is None:
            yield out(_IS_GONE, doc[again], row[again], line[again])
        order = order[new]  # lines of a word: by set, each once
        order = order[np.argsort(doc[order], kind="stable")]
        order = order[np.argsort(key[order].astype(np.uint64) << U(32) | size[order].astype(np.uint64), kind="stable")]
        key, tag, map_a, map_b, doc, row, line, size, place = (c[order] for c in (key, tag, map_a, map_b, doc, row, line, size, place))
        probe = np.ones(len(doc), bool) if open_ is None else passes(open_, _keys(doc, row, line))
        for x, y, more in _pairs(np.cumsum(heads(key)), map_a, map_b, doc, row, line, size, place, probe, percent, few):
            if len(x):
                yield out(np.where(more, _IS_MORE, _IS_PAIR), doc[x], row[x], line[x], doc[y], row[y], line[y], np.where(more, _word_keys(key, tag)[x].view(np.int64), 0))

    return run


def _filter(rows: DataFrame, *ends: tuple[str, str, str]) -> np.ndarray:
    """The filter of lines that rows name by these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [x.to_numpy() for x in batch.columns]
            keys = np.unique(np.concatenate([_keys(*c[i : i + 3]) for i in range(0, len(c), 3)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return sieve(rows.select(*[c for end in ends for c in end]).mapInArrow(run, "key long"), rows.count() * len(ends))


def _matched(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc, row, line) of pairs that match."""
    shared = texts.sparkSession.sparkContext.broadcast(_filter(pairs, _LATER, _FORMER))  # a filter of bounded size

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, part in pieces(batch.column(2)):
                data, offsets = raw(part)
                ends = np.sort(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]), kind="stable")
                text = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets)) + 1)
                first = np.flatnonzero(heads(text))
                number = (np.arange(len(text)) - first[text]).astype(np.int32)
                starts = np.where(number == 0, offsets[:-1][text], np.concatenate([[0], ends[:-1] + 1]))
                pick = np.flatnonzero(passes(shared.value, _keys(ids[lo:hi][text], rows[lo:hi][text], number)))
                if len(pick):
                    words = [data[a:b].tobytes() for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
                    of = text[pick]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][of]), pa.array(rows[lo:hi][of]), pa.array(number[pick]), pa.array(words, pa.binary())], names=["doc", "row", "line", "words"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, of = [], {}
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                one, two = of.get(a) or of.setdefault(a, frozenset(a.split())), of.get(b) or of.setdefault(b, frozenset(b.split()))
                both = len(one & two)
                good.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["doc", "row", "line"]).filter(pa.array(good, pa.bool_()))

    known = texts.select("doc", "row", "text").mapInArrow(lines, "doc long, row long, line int, words binary")
    known = written(known.dropDuplicates(["doc", "row", "line"]), "lines")  # of repeated rows, one
    other = known.select(*[F.col(a).alias(b) for a, b in zip(_LATER, _FORMER, strict=True)], F.col("words").alias("words2"))
    both = pairs.select(*_LATER, *_FORMER).distinct().join(known, [*_LATER]).join(other, [*_FORMER]).select(*_LATER, "words", "words2")
    return both.mapInArrow(verify, "doc long, row long, line int").distinct()


def _numbered(rows: DataFrame, doc: str, row: str, again: str) -> DataFrame:
    """rows with again: whether an equal row (by the columns doc and row) is kept in its place."""
    found = written(rows.where("text IS NOT NULL").groupBy(doc, row).agg(F.count("*").alias("n")).where("n > 1").select(doc, row), "repeats")
    if found.isEmpty():
        return rows.withColumn(again, F.lit(False))
    if found.limit(REPEATS + 1).count() <= REPEATS:
        found = F.broadcast(found)
    copy, first = free([*rows.columns, again], "copy", "first")
    copies = written(rows.join(found, [doc, row]).withColumn(copy, F.monotonically_increasing_id()), "copies")  # written: the numbers have to last
    firsts = copies.groupBy(doc, row).agg(F.min(copy).alias(copy)).select(copy, F.lit(False).alias(again))
    copies = copies.join(firsts, copy, "left").withColumn(again, F.coalesce(again, F.lit(True)))
    rest = rows.join(found, [doc, row], "left_anti").withColumn(again, F.lit(False))
    return rest.unionByName(copies.drop(copy))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with their text without the removed lines, and n_lines and n_removed (columns of these names are replaced)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    doc, row, lost, again = free([*names, "n_lines", "n_removed"], "doc", "row", "lost", "again")
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), row: row_key("text")})
    texts = rows.select(F.col(doc).alias("doc"), F.col(row).alias("row"), "text")
    counts, lines = _counts(texts)
    rank = np.zeros(BUCKETS, np.uint32)
    rank[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS, dtype=np.uint32)
    hot = int((counts <= HOT).sum())
    n = max(shards(spark), -(-((100 - percent) * int(counts.sum()) // 100 + lines) // PART))
    gone, only, open_ = None, None, None
    for few in (FEW, None):
        met = written(_sent(texts, rank, hot, n, percent, only).repartition(n, "shard").mapInArrow(_meet(percent, few, open_), _MET), "lines-met")
        pairs = met.where(F.col("kind") != _IS_GONE)
        matched = written(_matched(pairs, texts, percent), "lines-gone")
        gone = met.where(F.col("kind") == _IS_GONE).select(*_LATER).unionByName(matched) if gone is None else gone.unionByName(matched)
        left = written(pairs.where(F.col("kind") == _IS_MORE).select(*_LATER, "word").distinct().join(matched, [*_LATER], "left_anti"), "lines-open")
        if left.isEmpty():
            break
        only, open_ = sieve(left.select("word"), left.count()), _filter(left, _LATER)
    gone = gone.groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line").alias(lost))
    at = names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, total, removed = [], [], []
            for t, lines, copy in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                parts = [] if t is None else t.split("\n")
                if copy:
                    lines = [i for i, p in enumerate(parts) if p.strip(" \t\n\v\f\r")]
                total.append(len(parts))
                removed.append(len(lines or ()))
                if lines:
                    out = set(lines)
                    t = "\n".join(p for i, p in enumerate(parts) if i not in out)
                text.append(t)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    # The texts meet their removed lines in the one exchange they go through; merged, so that its size doesn't hang on a threshold.
    return _numbered(rows, doc, row, again).join(gone.hint("merge"), [doc, row], "left").select(*names, lost, again).mapInArrow(apply, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the kept text of every whole text of documents."""
    rows = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS set FROM l),
c AS MATERIALIZED (SELECT row_number() OVER () AS id, min({'d': doc_id, 'i': i}) AS spot, set, len(set) AS n FROM s WHERE len(set) > 0 GROUP BY set),
t AS MATERIALIZED (SELECT id, spot, n, unnest(set) AS x FROM c),
f AS (SELECT x, count(*) AS lines FROM t GROUP BY x HAVING count(*) > 1),
o AS (SELECT t.id, t.spot, t.n, t.x, f.lines, row_number() OVER (PARTITION BY t.id ORDER BY coalesce(f.lines, 1), t.x) AS place FROM t LEFT JOIN f USING (x)),
q AS MATERIALIZED (SELECT id, spot, n, x FROM o WHERE lines > 1 AND place <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM q a JOIN q b ON a.x = b.x AND a.spot < b.spot AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
near AS (SELECT DISTINCT b FROM (SELECT b, x.n AS n, y.n AS m, len(list_intersect(x.set, y.set)) AS common FROM pairs JOIN c x ON x.id = a JOIN c y ON y.id = b) WHERE 100 * common >= 80 * (n + m - common)),
marks AS (SELECT s.doc_id, s.i, s.line, c.id IS NOT NULL AND (c.spot <> {'d': s.doc_id, 'i': s.i} OR near.b IS NOT NULL) AS gone FROM s LEFT JOIN c ON c.set = s.set LEFT JOIN near ON near.b = c.id)
SELECT d.doc_id, CAST(CASE WHEN any_value(d.text) IS NULL THEN 0 ELSE count(*) END AS BIGINT) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256 FROM documents d JOIN marks USING (doc_id) GROUP BY d.doc_id
"""
