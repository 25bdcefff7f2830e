"""Substring dedup by recompression: every repeat of at least WINDOW words is found, whatever its place.

1. Naming. The words of each text are symbols. In each of ROUNDS rounds, runs of equal neighbours become one symbol,
   then pairs of unequal neighbours do where a hash bit of the first is 0 and that of the second is 1. Names are hashes
   of what they stand for, so they are the same in the whole corpus without any exchange. With each symbol goes the range of words
   its making depended on: wherever exactly these words occur, the same symbol does.
2. Revealing. Each window of WINDOW words takes the longest (of equal ones, the least) of the symbols that depend only on the window's words; neighbouring windows
   with the same symbol are a block. Equal windows take equal symbols, so a window can only repeat where its symbol does.
   A window without such a symbol (in runs of very few words) goes by its own hash.
3. Verifying. Blocks meet by symbol. A block whose whole word sequence (96 bits) also occurs in a document with a smaller id
   is a repeat. Of the other blocks, those whose symbol occurs in several documents (mostly at the ends of
   repeats) are compared window by window, by 128 bits of each window.
4. Removing. The repeats' ranges meet the texts; each word that one of them covers goes.

A batch compares its own blocks first and sends on only those with the smallest id, so a passage of a third of all
documents is one row of each batch. Symbols that many blocks of a batch share are dealt by the blocks' content instead.
Texts are shuffled once for each of the two joins; the first one's files go before the second.

Windows are judged on the input. Null text has no words; null doc_id comes before all others. Rows with the same doc_id are told
apart by their texts, and don't count as smaller than each other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import SCHEMA, deal, gathered, pack
from .shared import documents, row_key, shards, texts_of, tune, written
from .words import TOP, Rolling, U, hashed, heads, mix, pieces, raw, salted, split

WINDOW = 50
ROUNDS = 4
#: A symbol counts if its making depended on at most so many words before and from its first word.
BEFORE, FROM = 12, 16
#: More blocks of a symbol in one batch: they are dealt by content.
HOT = 64
_KINDS = ["<u8", "<u8", "<u4", "<i4", "<i8", "<i8", "<i4", "<u1"]  # key, hash, check, count, doc, row, at, state
_SENT, _SHARED, _SAMPLE, _REPEAT = range(4)
RANGES = "doc long, row long, at int, n int, repeat boolean"
_FAR = 1 << 40


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that words h (of documents doc) become: name, first word, and the range of words it depends on."""
    name, at = mix(h), np.arange(len(h))
    low, high = at, at + 1
    for r in range(rounds):
        if not len(name):
            break
        # Runs. That a symbol isn't part of a longer run depends on its neighbours; a text's ends depend on what isn't there.
        first = np.flatnonzero(heads(name, doc))
        last = np.concatenate([first[1:], [len(name)]]) - 1
        count = last - first + 1
        run = count > 1
        before = np.concatenate([[False], doc[first][1:] == doc[first][:-1]])
        after = np.concatenate([before[1:], [False]])
        left, right = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        left = np.minimum(left, np.where(before, low[first - 1], -_FAR))
        right = np.maximum(right, np.where(after, high[np.minimum(last + 1, len(name) - 1)], _FAR))
        name = np.where(run, mix(name[first] * U(0x9E3779B97F4A7C15) + count.astype(np.uint64) + salted(10 + r)), name[first])
        at, doc, low, high = at[first], doc[first], left, right
        # Pairs
        bit = (mix(name ^ salted(40 + r)) & U(1)).astype(bool)
        pair = ~bit & after
        pair[:-1] &= bit[1:]
        second = np.concatenate([[False], pair[:-1]])
        up = lambda x, fill: np.concatenate([x[1:], [fill]])
        down = lambda x, fill: np.concatenate([[fill], x[:-1]])
        new = np.where(pair, mix(name * U(0xC2B2AE3D27D4EB4F) + mix(up(name, U(0)) + salted(70 + r))), name)
        high_after, low_before = np.where(after, up(high, _FAR), _FAR), np.where(before, down(low, -_FAR), -_FAR)
        high = np.where(~bit, np.maximum(high, high_after), high)  # a 0 looks at what follows, paired or not
        low = np.where(bit & ~second, np.minimum(low, low_before), low)
        low = np.where(pair, np.minimum(low, up(low, 0)), low)
        keep = ~second
        name, at, doc, low, high = new[keep], at[keep], doc[keep], low[keep], high[keep]
    return name, at, low, high


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width]."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each word, and each text's first word (and the end)."""
    data, offsets = raw(texts)
    starts, ends = split(data, offsets)
    cuts = np.searchsorted(starts, offsets)
    return hashed(data, starts, ends), np.repeat(np.arange(len(texts)), np.diff(cuts)), cuts


def blocks(h: np.ndarray, doc: np.ndarray, cuts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Blocks of windows: key, hash, check, first window, number of windows, text."""
    name, at, low, high = recompress(h, doc)
    good = (at - low <= BEFORE) & (high - at <= FROM)
    width = window - BEFORE - FROM + 1
    value = np.full(len(h) + window, TOP, np.uint64)
    words = np.diff(np.append(at, len(h)))
    value[at[good]] = (U(15) - np.minimum(words, 15).astype(np.uint64))[good] << U(60) | mix(name[good]) >> U(5)  # the longest symbol, then the least
    least = _least(value[BEFORE:], width)
    begin = np.flatnonzero(np.arange(len(h)) + window <= cuts[1:][doc]) if len(h) else np.zeros(0, np.int64)
    key = least[begin]
    bare = np.flatnonzero(key == TOP)
    roll = Rolling(h, 1)
    key[bare] = mix(roll.of(begin[bare], begin[bare] + window) ^ salted(5))
    new = heads(key, doc[begin])
    if len(begin):
        new[1:] |= np.diff(begin) != 1
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(begin)]]))
    start, key = begin[first], key[first]
    end = start + count + window - 1
    hash_, check = roll.of(start, end), (Rolling(h, 3).of(start, end) >> U(32)).astype(np.uint32)
    return key, hash_, check, start, count.astype(np.int32), doc[start]


def _settled(key, hash_, check, count, doc, row, at, state):
    """All columns, sorted, and whether a smaller document has the same block."""
    order = np.lexsort((state, doc, count, check, hash_, key))
    key, hash_, check, count, doc, row, at, state = (c[order] for c in (key, hash_, check, count, doc, row, at, state))
    group = heads(key, hash_, check, count)
    owner = doc[np.maximum.accumulate(np.where(group, np.arange(len(doc)), 0))] if len(doc) else doc
    return key, hash_, check, count, doc, row, at, state, doc > owner


def _send(n: int, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """What a batch sends to the shards: see the module's third paragraph from the end."""
    key, hash_, check, count, doc, row, at, state, repeat = _settled(*columns)
    state = np.where(repeat, _REPEAT, state).astype(np.uint8)
    shard = mix(key + U(9))
    # hot symbols, of what isn't settled yet
    left = np.flatnonzero(~repeat)
    first = np.flatnonzero(heads(key[left]))
    size = np.diff(np.concatenate([first, [len(left)]]))
    extra: list[np.ndarray] = []
    for f, s in zip(first[size > HOT].tolist(), size[size > HOT].tolist(), strict=True):
        rows = left[f : f + s]
        if doc[rows].min() < doc[rows].max():
            extra += [rows[np.argmin(doc[rows])], rows[np.argmax(doc[rows])]]
            state[rows] = _SHARED
            shard[rows] = mix(hash_[rows] + U(11))
    shard[repeat] = mix(doc[repeat].astype(np.uint64))
    out = [key, hash_, check, count, doc, row, at, state]
    if extra:
        picked = np.array(extra)
        out = [np.concatenate([c, c[picked]]) for c in out]
        out[-1][-len(picked) :] = _SAMPLE
        shard = np.concatenate([shard, mix(key[picked] + U(9))])
    return pack(deal(n)[0][(shard % U(n)).astype(np.int64)], out)


def _result(doc, row, at, count, repeat) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(repeat, pa.bool_())], names=["doc", "row", "at", "n", "repeat"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a shard: repeats, and blocks whose symbol other documents' unsettled blocks have, too."""
    columns = gathered(batches, _KINDS)
    known = columns[-1] == _REPEAT
    if known.any():
        key, hash_, check, count, doc, row, at, state = (c[known] for c in columns)
        yield _result(doc, row, at, count, np.ones(len(doc), bool))
    columns = [c[~known] for c in columns]
    if not len(columns[0]):
        return
    key, hash_, check, count, doc, row, at, state, repeat = _settled(*columns)
    first = np.flatnonzero(heads(key))
    least, most = np.where(repeat, np.iinfo(np.int64).max, doc), np.where(repeat, np.iinfo(np.int64).min, doc)
    shared = np.minimum.reduceat(least, first) < np.maximum.reduceat(most, first)
    shared = np.repeat(shared, np.diff(np.concatenate([first, [len(key)]]))) | (state == _SHARED)
    keep = (repeat | shared) & (state != _SAMPLE)
    if keep.any():
        yield _result(doc[keep], row[keep], at[keep], count[keep], repeat[keep])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, row, text: neither of the first two is ever null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), row_key("text").alias("row"), "doc_id", "text")


def _met(sent: DataFrame, n: int) -> DataFrame:
    return sent.repartition(n, "shard").mapInArrow(_meet, RANGES)


def _ranges(texts: DataFrame, n: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, end, part in pieces(batch.column(2)):
                h, doc, cuts = _words(part)
                key, hash_, check, start, count, text = blocks(h, doc, cuts, window)
                if len(key):
                    yield _send(n, (key, hash_, check, count, ids[first:end][text], rows[first:end][text], (start - cuts[text]).astype(np.int32), np.zeros(len(key), np.uint8)))

    return _met(texts.select("doc", "row", "text").mapInArrow(run, SCHEMA), n)


def _windows(texts: DataFrame, n: int, window: int) -> DataFrame:
    """The windows of open blocks that repeat. texts: doc, row, text, open (array of at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, ranges = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for first, end, part in pieces(batch.column(2)):
                h, _, cuts = _words(part)
                spans = [(t, cuts[t] + r["at"], r["n"]) for t, list_ in enumerate(ranges[first:end]) for r in list_]
                if not spans:
                    continue
                text, at, count = (np.array(x, np.int64) for x in zip(*spans, strict=True))
                start = np.repeat(at - np.cumsum(count) + count, count) + np.arange(count.sum())
                text = np.repeat(text, count)
                one, two = Rolling(h, 1).of(start, start + window), Rolling(h, 3).of(start, start + window)
                yield _send(n, (one, mix(two), (two >> U(32)).astype(np.uint32), np.ones(len(one), np.int32), ids[first:end][text], rows[first:end][text], (start - cuts[text]).astype(np.int32), np.zeros(len(one), np.uint8)))

    return _met(texts.mapInArrow(run, SCHEMA), n).where("repeat")


def _cleaned(texts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(texts_of(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at the six characters between words
                n_words.append(len(words))
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array([r["at"] for r in ranges])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array([r["n"] for r in ranges]) + window - 1, -1)
                    words = list(compress(words, np.cumsum(edge)[:-1] == 0))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return texts.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_text."""
    if window < WINDOW:
        raise ValueError(f"windows have at least {WINDOW} words")
    spark = docs.sparkSession
    tune(spark)
    n = shards(spark)
    texts = _keyed(docs)
    found = written(_ranges(texts, n, window), "repeats")
    lists = lambda rows, name: rows.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "n")).alias(name))
    some = texts.join(lists(found.where("NOT repeat"), "open"), ["doc", "row"]).select("doc", "row", "text", "open")
    repeats = found.where("repeat").unionByName(written(_windows(some, n, window), "windows"))
    return _cleaned(texts.join(lists(repeats, "ranges"), ["doc", "row"], "left"), window)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k2 AS (SELECT *, hash(word || ' ' || lead(word) OVER d) AS h2 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k4 AS (SELECT *, hash([h2, lead(h2, 2) OVER d]) AS h4 FROM k2 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k8 AS (SELECT *, hash([h4, lead(h4, 4) OVER d]) AS h8 FROM k4 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k16 AS (SELECT *, hash([h8, lead(h8, 8) OVER d]) AS h16 FROM k8 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS MATERIALIZED (SELECT doc_id, i, word, CASE WHEN i + 49 <= n THEN [h16, lead(h16, 16) OVER d, lead(h16, 32) OVER d, lead(h2, 48) OVER d] END AS key FROM k16 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
least AS (SELECT key, min(doc_id) AS doc_id FROM k WHERE key IS NOT NULL GROUP BY key HAVING min(doc_id) < max(doc_id)),
marks AS (SELECT k.doc_id, k.i, k.word, bool_or(least.doc_id < k.doc_id) OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM k LEFT JOIN least USING (key)),
kept AS (SELECT doc_id, count_if(coalesce(gone, false)) AS n_removed, string_agg(CASE WHEN NOT coalesce(gone, false) THEN word END, ' ' ORDER BY i) AS text FROM marks GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
