"""Mixing sources to target weights, in DataFrame operations only.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Sources, in code point order
with null last, weigh 5, 2, 1, 5, 2, 1, ... and share all sizes. No source may be repeated more than
MOST times, so its target stops at MOST times its own size and the excess goes to the others by weight.
That has a closed form: with the sources in order of cap / weight, the level is the largest of
(all - caps before) / (weights - weights before), and a target is min(cap, weight * level).

Each document is emitted floor(rate) times, rate = target / source size, plus one copy with a probability of
the fraction, by a hash of seed and doc_id: reruns agree, whatever the partitioning.

Sources may be many (hosts). Numbers and running sums go over one row for each source, in ranges of about RANGE of them that add the
totals of the ranges before; only these totals are in one task. The targets are broadcast only if
there are at most BROADCAST_SOURCES of them; beyond that, they meet the documents in a join salted by
doc_id, so that a source with a third of all rows is spread over SALTS tasks.

Null source is a source of its own. Rows with the same doc_id get the same draw. A source of size 0 has target
0 and rate 0. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, free, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BROADCAST_SOURCES = 10_000
RANGE = 100_000
SALTS = 32
_WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def _running(rows: DataFrame, n: int, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows (of which there are n) with, by each name, the sum of a column over all rows before in this order, which has no ties."""
    values = {f"_{name}": value for name, value in sums.items()}
    rows = rows.withColumns(values)
    ranges = -(-n // RANGE)
    # Written: a range's number has to last. One range needs no exchange but the window's.
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "mix-ranges") if ranges > 1 else rows.withColumn("_range", F.lit(0))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner, outer = before(Window.partitionBy("_range").orderBy(*order)), before(Window.orderBy("_of"))
    totals = dealt.groupBy(F.col("_range").alias("_of")).agg(*[F.sum(c).alias(c) for c in values])
    totals = totals.select("_of", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"{c}_") for c in values])  # a row for each range
    met = dealt.join(F.broadcast(totals), F.col("_range") == F.col("_of"))
    return met.withColumns({name: F.coalesce(F.sum(f"_{name}").over(inner), F.lit(0)) + F.col(f"_{name}_") for name in sums}).drop("_range", "_of", *values, *[f"{c}_" for c in values])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: source, source_size, target, rate. sized: source, size."""
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n, everything = sums.agg(F.count("*"), F.sum("source_size")).head()
    last = F.col("source").asc_nulls_last()
    rows = _running(sums, n, [last], {"number": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    rows = written(rows.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "mix-weights")
    rows = _running(rows, n, [F.col("cap") / F.col("weight"), last], {"spent": F.col("cap"), "used": F.col("weight")})
    rows = written(rows.withColumn("level", (F.lit(everything) - F.col("spent")) / (F.lit(sum(weights) * (n // len(weights)) + sum(weights[: n % len(weights)])) - F.col("used"))), "mix-levels")
    level = rows.agg(F.max("level")).head()[0]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more if a draw in [0, 1) from the hash of seed and doc_id is below the fraction."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies (columns of these names are replaced)."""
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    return _counted(docs, weights, most, seed, ["mix_size", "mix_source_size", "mix_target", "mix_copies"])


def _counted(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str, names: list[str]) -> DataFrame:
    """docs with size, its source's size and target, and copies, by these names."""
    size, source_size, target, n = names
    own, rate, salt, part = free([*docs.columns, *names], "of", "rate", "salt", "part")
    sized = docs.withColumn(size, size_of(F.col("text")))
    targets = written(source_targets(sized.select("source", F.col(size).alias("size")), weights, most), "mix-targets")
    targets = targets.select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate))
    on = F.col("source").eqNullSafe(F.col(own))
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    else:
        targets = targets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn(part, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        on = on & (F.col(part) == F.col(salt))
    joined = sized.join(targets, on).drop(own, salt, part)
    return joined.withColumn(n, copies(F.col(rate), F.col("doc_id"), seed)).drop(rate)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as often as its copies, with the columns of docs, whatever their names."""
    names = free(docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    rows = _counted(docs, weights, most, seed, names).where(F.col(names[-1]) > 0)
    return rows.withColumn(names[0], F.explode(F.array_repeat(F.lit(0), F.col(names[-1]).cast("int")))).select(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_copies(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


MIX_SQL = r"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, [5, 2, 1][i % 3 + 1] AS weight, 3 * source_size AS cap,
                   sum(source_size) OVER () AS everything, sum([5, 2, 1][i % 3 + 1]) OVER () AS weights FROM sums),
levels AS (SELECT *, CAST(everything - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(weights - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lev
           FROM weighed WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (max(lev) OVER ())) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
mixed AS (SELECT sized.*, rated.source_size, rated.target,
                 CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS n
          FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source)
"""
OP3_SQL = "WITH " + MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, n * size AS taken FROM mixed"
