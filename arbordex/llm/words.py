"""Words of many texts at once: where they are and 64-bit hashes, by array operations on Arrow's buffers.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes are never part of another UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

from .shared import texts_of

U = np.uint64
#: Texts are worked on in pieces of about so many bytes (or one text), which bounds a worker's memory.
PIECE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 512
TOP = np.iinfo(np.uint64).max


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def salted(salt: int) -> np.uint64:
    return mix(np.array([salt * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64))[0]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    return word, lower, masks


def pieces(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, texts) for pieces of a text column."""
    texts = texts_of(column)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        yield first, end, texts.slice(first, end - first)
        first = end


def raw(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of texts and the offset of each text in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (_tables()[1][data] if lower else data), offsets - offsets[0]


def split(data: np.ndarray, cuts: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words. No word goes over a cut."""
    word = (_tables()[0] if is_word is None else is_word)[data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = cuts[(cuts > 0) & (cuts < len(word))]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: eight bytes of all words at a time."""
    masks = _tables()[2]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) ^ mix(lanes[starts] & masks[np.minimum(size, 8)]))
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(rest):
        left = size[rest] - at
        h[rest] = mix((h[rest] * U(0x9E3779B97F4A7C15)) ^ (lanes[starts[rest] + at] & masks[np.minimum(left, 8)]))
        rest = rest[left > 8]
        at += 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


class Rolling:
    """Hashes of any ranges of a sequence of hashes."""

    def __init__(self, h: np.ndarray, salt: int) -> None:
        base = int(salted(salt)) | 1
        power, self.inverse = _powers(base, len(h) + 1)
        self.sums = np.concatenate([[U(0)], np.cumsum(mix(h ^ salted(salt + 1)) * power[: len(h)])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * U(0x632BE59BD9B4E019))


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _KEPT or len(_KEPT[base][0]) < n:
        size = max(n, 1 << 16)
        _KEPT[base] = tuple(np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    return _KEPT[base]


def heads(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out
