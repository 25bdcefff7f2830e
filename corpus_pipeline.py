"""The corpus pipeline: five stages, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and any others that
docs has, whatever their names. What a stage decides takes effect:

- language_id drops documents without letters (null texts are) and those too far from every language's centroids;
- line_dedup takes out lines that match an earlier line, and documents of which no word is left by that; n_chars follows the text;
- ngram_join keeps one document of each group of near-duplicates (five-word shingles, 0.8): the one of the smallest doc_id;
- mix_sources repeats or drops documents towards the sources' target weights; a null source is one of its own;
- bpe encodes and decodes what is left; a null text is empty.

Null doc_ids come before all others in line_dedup and after all others in ngram_join. Of rows that repeat, line_dedup leaves one its
lines, so the others go. Very long texts are worked on whole. An empty table gives an empty table at every stage. A stage's table is
deleted when the next one's is written, the last when the session ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm import bpe, language_id, line_dedup, mixing, ngram_join
from arbordex.llm.shared import free
from arbordex.storage import discard, shared_folder, stored_at

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fitted(spark, docs))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    aside = dict(zip(("n_lines", "n_removed"), free([*docs.columns, "n_lines", "n_removed"], "n_lines", "n_removed"), strict=True))
    rows = line_dedup.dedup_lines(docs.withColumnsRenamed(aside)).where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    rows = rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.drop(*aside).withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, 5, 80).select(*docs.columns)


def stage_mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_columns(bpe.encode(docs.select("doc_id", "text"), decode=True))


STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("ngram_join", stage_ngram_join),
    ("mix_sources", stage_mix_sources),
    ("bpe", stage_bpe),
]

#: Language ID, the two similarity joins and BPE aren't SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = stored_at(spark, path, out.schema)
        discard(*before)
        before = [docs]
    return docs
