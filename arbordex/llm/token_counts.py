"""Token counts by a Viterbi search that only counts.

An Aho-Corasick automaton enumerates every piece of a unigram vocabulary in a text. For each position, the search
carries the best score of a way there and that way's number of pieces: no pieces are kept, nothing is traced
back, and only as many positions as the longest piece has characters are held.

The rules are those of the tokenizers library's Unigram model: a way replaces another only if its score is larger, so
of equal ways the one whose last piece starts first stays; a character without a piece of its own may be taken as
unknown at 10 below the lowest score; neighbouring unknowns are one token, or as many as they have bytes if the
vocabulary has a piece for each byte.

Texts are cut before a space that follows another character, if that can't change the result: no piece
spans such a place, the space mark is a piece and all scores are whole numbers (sums of them are exact). Counts
of cut pieces are kept, at most KEPT a worker.

The box has no trained unigram vocabulary and none may be trained; by default the pieces and scores of the public
32k piece file are read as a unigram vocabulary. Any list of (piece, score) can be given.

Null and empty texts have 0 tokens. Rows that repeat are counted one by one; an empty table gives an empty table. A column
n_tokens of the input is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import documents, texts_of, tune

MARK = "▁"
KEPT = 400_000
#: Longer pieces of text aren't kept.
LONG = 200
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


def default_vocabulary() -> list[tuple[str, float]]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(len(model))]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0) -> None:
        pieces = dict(vocabulary)
        if max(pieces.values(), default=0) >= 20:
            raise ValueError("scores are logarithms of probabilities")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.by_bytes = sum(bool(_BYTE.fullmatch(p)) for p in pieces) == 256
        self.lowest = min(pieces.values(), default=0.0) - 10.0
        self.ring = 1 << (max(map(len, pieces), default=1) + 1).bit_length()
        spans = any(MARK in p.lstrip(MARK) for p in pieces)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if MARK in self.single and not spans and all(float(s).is_integer() for s in pieces.values()) else lambda t: [t]
        self.kept: dict[str, int] = {}

    def search(self, text: str) -> int:
        """The number of tokens of a normalised text."""
        mask, lowest, single, by_bytes = self.ring - 1, self.lowest, self.single, self.by_bytes
        none = float("-inf")
        best, count, unknown = [none] * self.ring, [0] * self.ring, [False] * self.ring
        best[0] = 0.0
        matches = self.automaton.iter(text)
        end, match = next(matches, (-1, None))
        for at, char in enumerate(text, 1):
            top, pieces, as_unknown = none, 0, False
            while match is not None and end == at - 1:  # the longest first: the one that starts first
                start = (at - match[0]) & mask
                if (score := best[start] + match[1]) > top:
                    top, pieces, as_unknown = score, count[start] + 1, False
                end, match = next(matches, (-1, None))
            if char not in single:
                start = (at - 1) & mask
                if (score := best[start] + lowest) > top:
                    top, as_unknown = score, True
                    pieces = count[start] + (len(char.encode("utf-8", "surrogatepass")) if by_bytes else not unknown[start])
            here = at & mask
            best[here], count[here], unknown[here] = top, pieces, as_unknown
        return count[len(text) & mask]

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, kept = 0, self.kept
        for part in self.cut(MARK + text.replace(" ", MARK)):
            n = kept.get(part)
            if n is None:
                n = self.search(part)
                if len(part) <= LONG:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[part] = n
            total += n
        return total


@cache
def _counter(vocabulary: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(list(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None) -> DataFrame:
    """docs with n_tokens."""
    tune(docs.sparkSession)
    docs = docs.drop("n_tokens")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary or default_vocabulary()))  # as large as the vocabulary, not the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            found = [counter.count(t) for t in texts_of(batch.column(names.index("text"))).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every whole text of documents."""
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_tokens")
