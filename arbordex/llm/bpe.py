"""Byte-level BPE encoding and decoding with a transducer lexicon.

The most frequent pre-tokens of the corpus are compiled, with their ids, into a minimal acyclic transducer (lexicon.py). Its
file is sent to each executor once and mapped into memory. Words that it doesn't hold are merged exactly, all
new words of a batch at a time: in each step, every word merges its leftmost pair of the lowest rank.

The lexicon only saves time: which words it holds doesn't change any id. It is bounded by LEXICON words; the counts that
choose them cover the whole corpus.

The ids are those of the tokenizers library for the same file with add_special_tokens=False: strings of added tokens
become their ids, everything else is split by PATTERN and merged. Decoding joins the tokens' bytes and replaces what isn't
UTF-8. Null text counts as empty and has no ids. Rows that repeat are encoded one by one; an empty table gives an
empty table. Columns of the input with the names of the output are replaced.
"""

from __future__ import annotations

import heapq
import json
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import Lexicon, compile_lexicon
from .shared import documents, texts_of, tune, written

LEXICON = 1 << 16
#: A worker keeps the ids of at most so many words between batches.
KEPT = 400_000
#: Longer words are merged one by one, by a heap.
LONG = 64
# Fixed value: how the vocabulary's pre-tokenizer splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int32).max
_SLOTS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes: themselves where they can be seen, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What a byte-level BPE file of the tokenizers library holds."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
        if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        symbols = _byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: raw(t) for t, i in ids.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.byte = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.byte[b] = ids[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pair = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        # The same as arrays, found by hash: slots that are taken by another pair go one on.
        self.slot_key = np.full(_SLOTS, -1, np.int64)
        self.slot_rank, self.slot_id = np.full(_SLOTS, _NONE, np.int32), np.zeros(_SLOTS, np.int32)
        for (a, b), (rank, new) in self.pair.items():
            key = a << 32 | b
            at = int(self._slots(np.array([key]))[0])
            while self.slot_key[at] >= 0:
                at = (at + 1) % _SLOTS
            self.slot_key[at], self.slot_rank[at], self.slot_id[at] = key, rank, new
        self.split = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the pairs, -1 where there is no merge."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slots(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.slot_key[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (held >= 0)]
            at[todo] = (at[todo] + 1) % _SLOTS
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by a heap of pairs."""
        ids = [int(self.byte[b]) for b in word]
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(self.pair[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pair]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j], right[i] = self.pair[p][1], False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (q := (ids[x], ids[y])) in self.pair:
                    heapq.heappush(heap, (self.pair[q][0], x, q))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian int32s."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.merge(w), "<i4").tobytes()
        owner = np.array(short, np.int64)
        lengths = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        symbols = self.byte[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        while len(owner):
            starts = np.cumsum(lengths) - lengths
            last = np.zeros(len(symbols), bool)
            last[starts + lengths - 1] = True
            inner = np.flatnonzero(~last)
            slot = np.full(len(symbols), -1, np.int64)
            slot[inner] = self.lookup(symbols[inner], symbols[inner + 1])
            rank = np.where(slot >= 0, self.slot_rank[slot], _NONE)
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            for k in np.flatnonzero(done).tolist():
                out[owner[k]] = symbols[starts[k] : starts[k] + lengths[k]].astype("<i4").tobytes()
            word = np.repeat(np.arange(len(owner)), lengths)
            here = np.flatnonzero((rank == lowest[word]) & ~done[word])
            first = here[np.concatenate([[True], np.diff(word[here]) != 0])] if len(here) else here
            symbols[first] = self.slot_id[slot[first]]
            keep = ~done[word]
            keep[first + 1] = False
            symbols, owner, lengths = symbols[keep], owner[~done], lengths[~done] - 1
        return out


@cache
def _vocabulary(text: str) -> Vocabulary:
    """A vocabulary file's text, read; kept for as long as the worker is."""
    return Vocabulary(text)


def _sent(docs: DataFrame, path: str) -> Broadcast:
    """The driver's vocabulary file for the executors, which needn't have it (some MB, whatever the data)."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


class Encoder:
    """Encodes texts; keeps the ids of words it has met."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.lexicon, self.known = vocabulary, lexicon, {}
        self.special = {s: np.array([i], "<i4").tobytes() for s, i in vocabulary.special.items()}

    def words(self, text: str) -> list[str]:
        split = self.vocabulary.split.findall
        if self.vocabulary.special_split and any(s in text for s in self.special):
            return list(chain.from_iterable([part] if part in self.special else split(part) for part in self.vocabulary.special_split.split(text)))
        return split(text)

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        self.known.update(self.special)
        new = [w for w in words if w not in self.known]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        if self.lexicon is not None:
            places = self.lexicon.find(raw)
            for i in np.flatnonzero(places >= 0).tolist():
                self.known[new[i]] = self.lexicon.output(int(places[i])).tobytes()
            rest = np.flatnonzero(places < 0).tolist()
        else:
            rest = range(len(new))
        for i, ids in zip(rest, self.vocabulary.merge_all([raw[i] for i in rest]), strict=True):
            self.known[new[i]] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        found: set[str] = set()
        for words in split:
            found.update(words)
        self.learn(found)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, vocabulary: Broadcast, most: int = LEXICON) -> list[str]:
    """The most frequent pre-tokens of all texts: at most `most`, which bounds what the driver gets."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(_vocabulary(vocabulary.value)), Counter()
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in texts_of(batch.column(0)).to_pylist():
                seen.update(w for w in encoder.words(text) if len(w) <= LONG)
            if len(seen) > KEPT:
                yield as_batch()
                seen.clear()
        if seen:
            yield as_batch()

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1"), "words")
    # A sort would send each task's first words to the driver. A histogram of counts (under 600 steps) tells which words are frequent.
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    least, held = 0, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if held + r["words"] > most:
            least = r["step"] + 1
            break
        held += r["words"]
    return sorted(r["word"] for r in counted.where(step >= least).select("word").collect())


def build_lexicon(docs: DataFrame, vocabulary: Broadcast, most: int = LEXICON) -> str:
    """Compile the lexicon and send its file to the executors; its name there."""
    words = frequent_words(docs, vocabulary, most)
    ids = _vocabulary(vocabulary.value).merge_all([w.encode() for w in words])
    entries = {w.encode(): np.frombuffer(x, "<i4").tolist() for w, x in zip(words, ids, strict=True)}
    path = Path(tempfile.mkdtemp(prefix="arbordex-")) / f"lexicon-{uuid.uuid4().hex}"
    compile_lexicon(entries, path)
    docs.sparkSession.sparkContext.addFile(str(path))
    return path.name


def encode(docs: DataFrame, vocabulary: str | None = None, most: int = LEXICON, decode: bool = False) -> DataFrame:
    """docs with ids (array of int), and with decoded (the text from these ids) if asked for."""
    tune(docs.sparkSession)
    shared = _sent(docs, vocabulary or default_vocabulary())
    docs = docs.drop("ids", "decoded")
    names = docs.columns
    lexicon = build_lexicon(docs, shared, most)
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(shared.value), Lexicon(SparkFiles.get(lexicon)))
        for batch in batches:
            ids = encoder.encode(texts_of(batch.column(names.index("text"))).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))]
            if decode:
                columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(f.name for f in extra)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def digest_columns(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode(..., decode=True) gives."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(encode(documents(spark, sf_dir).select("doc_id", "text"), decode=True))
