"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Each input
partition is a run: sorted by digest, one row for each with how many rows it stands for and which of them
stays (most code points, then smallest doc_id). In each round, FAN_IN neighbouring runs (two binomial rounds, pairs and fours)
exchange their rows, are sorted by digest and merged, which keeps the smallest identifier; after log(runs) rounds one run, dealt by
digest, is left. There are as many runs as the input has partitions, RUNS for each shuffle partition at most.

Digests are verified: besides SHA-256 the key holds the length and a second hash of the normalised text,
so rows merge only if all three agree, at every level. A digest that a third of all rows share is one row
of each run before anything is exchanged. The verdicts of groups with a share of 1 / HOT of all rows or more (HOT at most) go back to
their rows by a broadcast, those of the others by a join: no task gets a large group.

Null text counts as empty. Null doc_id comes after all others. Rows that repeat a doc_id count one by one;
those of them with the same text share a verdict. Other columns play no part, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, shards, written

FAN_IN = 4
RUNS = 64
HOT = 1000
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["text_sha256", "norm_chars", "norm_hash"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the digest key and the run of each row; the text is read once and goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.translate(text, BLANKS, "").alias("norm"))
    return rows.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), F.length("norm").alias("norm_chars"), F.xxhash64("norm").alias("norm_hash"), F.spark_partition_id().alias("run"))


def _merged(rows: DataFrame, run) -> DataFrame:
    """Runs with the same number become one: a row for each digest, of the rows' smallest (best) identifier."""
    return rows.groupBy(run.alias("run"), *KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


def exact_groups(rows: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each distinct digest: KEY, keep_id, keep_chars, group_size. rows: from digests()."""
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"))
    level = rows.select(F.pmod("run", F.lit(runs)).alias("run"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("rows"))
    while True:
        runs = -(-runs // fan_in)
        level = _merged(level, F.floor(F.col("run") / fan_in) if runs > 1 else F.lit(0))
        if runs <= 1:
            return level.select(*KEY, F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    rows = written(digests(docs), "digests")
    n, last = rows.agg(F.count("*"), F.max("run")).head()
    groups = written(exact_groups(rows, min((last or 0) + 1, RUNS * shards(rows.sparkSession))), "groups")
    hot = F.col("group_size") * HOT >= n
    large = F.broadcast(groups.where(hot))  # HOT rows at most
    met = rows.join(large, KEY).unionByName(rows.join(large.select(*KEY), KEY, "left_anti").join(groups.where(~hot), KEY))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_chars")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256, CAST(n_chars AS BIGINT) AS n_chars
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
