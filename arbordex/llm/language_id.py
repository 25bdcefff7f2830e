"""Language ID by nearest centroids.

A text becomes a TF-IDF vector of its letter n-grams (1 to 3, lower-cased, within words), hashed to BUCKETS
dimensions and scaled to length 1. Each language has up to CLUSTERS centroids, found by spherical k-means. A
text gets the language of the centroid with the largest cosine.

Rejection by distance. A text of few different n-grams is far from any centroid, so each language has a limit for each
power of two of them: KEEP times the cosine that all but a share of LOWEST of its training texts reach. These are taken whole
and, CUT_TEXTS of them, cut to the lengths CUTS. A language's limit of a size that it has under FEWEST texts of is that of all languages'
texts of the size, and without these that of the next smaller size, or of the next larger one over the square root of 2. Texts below
their language's limit are rejected.

Fitting uses a bounded sample: at most PER_LANGUAGE rows of each language, chosen by a hash of doc_id and text among rows
of at most SAMPLE_CHARS code points. The driver holds a few MB for each language, so languages are to be at most some hundreds.
Prediction reads every whole text.

Null texts and texts without a letter are ``und`` with score 0, and rejected. Ties go to the language
first by code point. Without any training row, every text is ``und``. Columns of the input that have the
names of the output are replaced. Rows with the same doc_id are predicted one by one. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, documents, texts_of, tune, written

BUCKETS = 1 << 14
CLUSTERS = 3
PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000
ROUNDS = 8
KEEP, LOWEST, FEWEST = 0.6, 0.01, 30
CUT_TEXTS, CUTS = 100, (10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120)
_GROUP, _CHUNK = 16, 1 << 20
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(pieces: list[tuple[int, str]]) -> np.ndarray:
    """pieces: (row, text) pairs. row * BUCKETS + bucket for each n-gram."""
    lowered = [t.lower() + " " for _, t in pieces]
    codes = np.frombuffer((" " + "".join(lowered)).encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.concatenate([[0], np.repeat([r for r, _ in pieces], [len(t) for t in lowered])])
    codes = np.where(_letters()[codes], codes, _SPACE).astype(np.uint64)
    blank = codes == _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes, rows, blank = codes[keep], rows[keep], blank[keep]
    mixed = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
    one = ~blank
    a, b = codes[:-1], codes[1:]
    two = (a << np.uint64(21)) | b | np.uint64(1 << 62)
    three = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[~blank[1:-1]]
    return np.concatenate([rows[one] * BUCKETS + mixed(codes[one] | np.uint64(1 << 61)), np.where(blank[:-1], rows[1:], rows[:-1]) * BUCKETS + mixed(two), rows[1:-1][~blank[1:-1]] * BUCKETS + mixed(three)])


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, a row for each text. Long texts are counted piece by piece, cut between words."""
    total = np.zeros((len(texts), BUCKETS), np.int64)
    held: list[tuple[int, str]] = []

    def flush() -> None:
        if held:
            np.add(total, np.bincount(_grams(held), minlength=total.size).reshape(total.shape), out=total)
            held.clear()

    room = _CHUNK
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + _CHUNK)
            if end < len(text) and (cut := text.rfind(" ", at, end)) > at:
                end = cut
            held.append((row, text[at:end]))
            room -= end - at
            at = end
            if room <= 0:
                flush()
                room = _CHUNK
    flush()
    return total


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means. Starts at the mean's nearest text, then always at the text furthest from all chosen."""
    chosen = [int(np.argmax(v @ v.mean(0)))]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin((v @ v[chosen].T).max(1))))
    centroids = v[chosen]
    for _ in range(ROUNDS):
        nearest = (v @ centroids.T).argmax(1)
        centroids = np.stack([v[nearest == i].mean(0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


class Sparse:
    """n-gram counts of a few texts, without the zeros."""

    def __init__(self, texts: list[str]) -> None:
        parts = [counts(texts[i : i + _GROUP]) for i in range(0, len(texts), _GROUP)]
        parts = [n[n.sum(1) > 0] for n in parts]
        self.rows = sum(map(len, parts))
        found = [np.nonzero(n) for n in parts]
        first = np.cumsum([0, *map(len, parts)])
        self.at = np.concatenate([r + f for (r, _), f in zip(found, first, strict=False)] or [np.zeros(0, np.int64)]).astype(np.int32)
        self.bucket = np.concatenate([b for _, b in found] or [np.zeros(0, np.int64)]).astype(np.int32)
        self.n = np.concatenate([n[i] for n, i in zip(parts, found, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int32)

    def texts_with(self) -> np.ndarray:
        return np.bincount(self.bucket, minlength=BUCKETS)

    def vectors(self, idf: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        end = self.rows if end is None else end
        some = (self.at >= first) & (self.at < end)
        dense = np.zeros((end - first, BUCKETS), np.float32)
        dense[self.at[some] - first, self.bucket[some]] = self.n[some]
        return vectors(dense, idf)


def size_class(distinct: np.ndarray) -> np.ndarray:
    """The power of two of a number of different n-grams."""
    return np.log2(np.maximum(distinct, 1)).astype(np.int64)


def limits(fits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """fits: for each language the cosines and different n-grams of its texts. The least cosine by language and size class."""
    classes = BUCKETS.bit_length()
    low = lambda cos: KEEP * float(np.quantile(cos, LOWEST))
    sized = [[cos[size_class(n) == k] for k in range(classes)] for cos, n in fits]
    out = np.zeros((len(fits), classes), np.float32)
    for k in range(classes):
        pool = np.concatenate([c[k] for c in sized])
        before = out[:, k - 1] if k else np.zeros(len(fits))
        out[:, k] = [low(c[k]) if len(c[k]) >= FEWEST else low(pool) if len(pool) >= FEWEST else b for c, b in zip(sized, before, strict=True)]
    for k in reversed(range(classes - 1)):
        out[:, k] = np.where(out[:, k] == 0, out[:, k + 1] / np.sqrt(2), out[:, k])
    return out


def fit(spark: SparkSession, labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model from labelled rows (doc_id, text, lang): languages, idf, centroids, their languages and the limits."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= SAMPLE_CHARS)
    found = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    empty = {"languages": [], "idf": None, "centroids": None, "of": None, "limits": None}
    if not found:
        return empty
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rate = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, float(min(1.0, 1.5 * per_language / n)) * (1 << 30))])
    drawn = written(usable.withColumn("draw", draw).where(F.col("draw") < F.element_at(rate, F.col("lang"))).select("lang", "draw", "text"), "sample")
    grams, cut = {}, {}
    for lang in sorted(found):
        texts = [r["text"] for r in drawn.where(F.col("lang") == lang).orderBy("draw", "text").limit(per_language).collect()]  # a bounded sample of short texts
        whole = Sparse(texts)
        if whole.rows:
            grams[lang] = whole
            cut[lang] = Sparse([t[:k] for t in texts[:CUT_TEXTS] for k in CUTS if len(t) > k])
    discard(drawn)
    languages = list(grams)
    if not languages:
        return empty
    rows = sum(n.rows for n in grams.values())
    idf = (np.log((1 + rows) / (1 + sum(n.texts_with() for n in grams.values()))) + 1).astype(np.float32)
    centroids, of, fits = [], [], []
    for i, lang in enumerate(languages):
        own = _clusters(grams[lang].vectors(idf), CLUSTERS).astype(np.float32)
        centroids.append(own)
        of += [i] * len(own)
        near = [(v @ own.T).max(1) for n in (grams[lang], cut[lang]) for f in range(0, n.rows, _GROUP) for v in [n.vectors(idf, f, min(f + _GROUP, n.rows))]]
        fits.append((np.concatenate(near), np.concatenate([np.bincount(n.at, minlength=n.rows) for n in (grams[lang], cut[lang])])))
    return {"languages": languages, "idf": idf, "centroids": np.concatenate(centroids), "of": np.array(of), "limits": limits(fits)}


def predict_texts(model: dict, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not model["languages"]:
        return langs, scores, rejected
    for start in range(0, len(texts), _GROUP):
        n = counts(texts[start : start + _GROUP])
        size = size_class((n > 0).sum(1))
        cos = vectors(n, model["idf"]) @ model["centroids"].T
        for i in np.flatnonzero(n.any(1)).tolist():
            best = int(cos[i].argmax())
            score, lang = float(np.clip(cos[i, best], 0, 1)), int(model["of"][best])
            langs[start + i], scores[start + i] = model["languages"][lang], score
            rejected[start + i] = bool(score < model["limits"][lang, size[i]])
    return langs, scores, rejected


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 200 KB for each language: CLUSTERS x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = predict_texts(shared.value, texts_of(batch.column(names.index("text"))).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns, whatever their names."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 200 KB for each language: CLUSTERS x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not r for r in predict_texts(shared.value, texts_of(batch.column(at)).to_pylist())[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fitted(spark: SparkSession, docs: DataFrame) -> dict:
    """The model of the labelled rows that aren't held out."""
    return fit(spark, docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False))))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = predict(docs.select("doc_id", "text"), fitted(spark, docs))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def crc_remainder(doc_id: int) -> int:
    """What held_out() looks at, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3
