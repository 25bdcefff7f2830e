"""URL filters by fixed rules and by mined association rules.

Fixed rules (host, path) come first: a rule fits its host and all subdomains if the url's path starts with the rule's; the longest
rule that fits decides. For all other urls the method decides:

1. A url's items are its host's labels, the words of its path (numbers left out), its ending, and the names in its query.
2. Labelled pages are transactions of their items and, where the label says so, of BLOCK. Spark's FP-growth mines the combinations that
   at least SUPPORT of the transactions hold, and at least LEAST blocked ones however few are labelled; rules of the form items -> BLOCK with a confidence of CONFIDENCE or more stay, but for
   those that a rule of fewer items makes needless. All of these are kept. Items that make rules alone or
   that the same pages have are set apart first, so their combinations are never mined.
3. An inverted index has each rule under its rarest item: broadcast for at most MOST_RULES rules, a join beyond. A url is blocked if it holds all items of a rule.

A host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path goes on up to ``?``, ``#`` or the end.
A null url and one without ``://`` have an empty host and path, and no rule fits. Labels: page_id meets doc_id; quality 0 or toxic 1 means
block; a null counts as no objection; of repeated labels any objection counts. Without labelled pages nothing is mined and the method
allows all. Rows that repeat are judged one by one; an empty table gives an empty table. Very long urls are read whole; only their
distinct items count. Every labelled page counts, with or without items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import texts_of, tune, written

SUPPORT, CONFIDENCE = 0.002, 0.6
#: Blocked pages that a rule has to hold for at any size of the input: a few may agree by chance.
LEAST = 20
MOST_RULES = 10_000
BLOCK = "=block"
# The rules of the registered query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host_ == domain) | F.endswith(host_, F.lit("." + domain))) & F.startswith(path_, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def items(url: str) -> list[str]:
    """The distinct items of a url."""
    _, mark, rest = url.partition("://")
    if not mark:
        return []
    rest, _, _ = rest.partition("#")
    rest, _, query = rest.partition("?")
    host_, _, path_ = rest.partition("/")
    ending = re.search(r"\.(\w{1,5})$", path_)
    found = [f"host:{x}" for x in host_.translate(str.maketrans(_UPPER, _LOWER)).split(".") if x]
    found += [f"path:{x.lower()}" for x in re.split(r"[\W_]+", path_) if x and not x.isdigit()]
    found += [f"ending:{ending[1].lower()}"] if ending else []
    found += [f"query:{x.partition('=')[0].lower()}" for x in query.split("&") if x]
    return sorted(set(found))


def _items(urls: DataFrame, *names: str) -> DataFrame:
    """urls with their items: the columns of these names and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [items(u) for u in texts_of(batch.column(names.index("url"))).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*names, "items"])

    rows = urls.select(*names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("items", T.ArrayType(T.StringType()))]))


def _smallest(rules: DataFrame) -> DataFrame:
    """rules (items, confidence) that hold no other rule's items."""
    kept, left = rules.limit(0), written(rules, "rules-left")
    while not left.isEmpty():
        k = left.agg(F.min(F.size("items"))).first()[0]
        now, more = left.where(F.size("items") == k), left.where(F.size("items") > k)
        inner = now.select(F.element_at("items", 1).alias("key"), F.col("items").alias("inner"))
        needless = more.select("items", F.explode("items").alias("key")).join(inner, "key").where(F.size(F.array_except("inner", "items")) == 0).select("items").distinct()
        kept, left = kept.unionByName(now), written(more.join(needless, "items", "left_anti"), "rules-left")
    return kept


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Rules (items, confidence) from labelled pages: url, block."""
    tune(labelled.sparkSession)
    pages = written(_items(labelled, "url", "block").select(F.monotonically_increasing_id().alias("id"), "block", "items"), "labelled")
    n = pages.count()
    enough = max(1, least, math.ceil(support * n))
    long = pages.select("id", "block", F.explode("items").alias("item"))
    a, b = F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b")
    each = written(long.groupBy("item").agg(F.count("*").alias("pages"), F.count_if("block").alias("blocked"), a, b).where(F.col("blocked") >= enough), "items")
    share = F.col("blocked") / F.col("pages")
    rules = each.where(share >= confidence).select(F.array("item").alias("items"), share.alias("confidence"))
    # What an item of these blocks needs no other; items of the same pages can stand for each other.
    classes = written(each.where(share < confidence).groupBy("pages", "blocked", "a", "b").agg(F.min("item").alias("class"), F.collect_list("item").alias("members")).select("class", "members"), "classes")
    rows = long.join(classes.select("class", F.explode("members").alias("item")), "item").groupBy("id", "block").agg(F.collect_set("class").alias("items"))
    rows = written(rows.select(F.when(F.col("block"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items")), "transactions")
    m = rows.count()
    if m < enough:
        return rules
    model = FPGrowth(itemsCol="items", minSupport=(enough - 0.5) / m, minConfidence=confidence).fit(rows)
    found = _smallest(model.associationRules.where(F.array_contains("consequent", BLOCK)).select(F.array_sort("antecedent").alias("items"), "confidence"))
    lists = found.select("items", "confidence", F.explode("items").alias("class")).join(classes, "class").groupBy("items", "confidence").agg(F.collect_list("members").alias("lists"))
    every = F.expr("aggregate(lists, array(cast(array() as array<string>)), (x, m) -> flatten(transform(x, y -> transform(m, z -> array_append(y, z)))))")
    return rules.unionByName(lists.select(F.explode(every).alias("items"), "confidence").select(F.array_sort("items").alias("items"), "confidence"))


def _listed(rules: DataFrame) -> list[tuple[frozenset[str], float]]:
    found = [(sorted(r["items"]), r["confidence"]) for r in rules.collect()]
    return [(frozenset(i), c) for i, c in sorted(found, key=lambda r: (len(r[0]), -r[1], r[0]))]


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> list[tuple[frozenset[str], float]]:
    return _listed(mined(labelled, support, confidence, least))


def index_of(rules: list[tuple[frozenset[str], float]]) -> dict[str, list[frozenset[str]]]:
    """Each rule under the item that the fewest rules have."""
    common = Counter(i for have, _ in rules for i in have)
    index: dict[str, list[frozenset[str]]] = {}
    for have, _ in rules:
        index.setdefault(min(have, key=lambda i: (common[i], i)), []).append(have)
    return index


def _met(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url and mined of the urls that a rule blocks: a join on each rule's rarest item."""
    long = rules.select("items", F.explode("items").alias("key"))
    common = long.groupBy("key").agg(F.count("*").alias("n"))
    keyed = long.join(common, "key").groupBy("items").agg(F.min(F.struct("n", "key"))["key"].alias("key")).select("key", F.col("items").alias("rule"))
    urls = _items(pages.select("url").where("url IS NOT NULL").distinct(), "url")
    hits = urls.select("url", "items", F.explode("items").alias("key")).join(keyed, "key").where(F.size(F.array_except("rule", "items")) == 0)
    return hits.groupBy("url").agg(F.min(F.array_join(F.array_sort("rule"), " ")).alias("mined"))


def judge(pages: DataFrame, rules: list[tuple[frozenset[str], float]] | DataFrame, fixed: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and mined (the items of the mined rule that blocks the url)."""
    spark = pages.sparkSession
    tune(spark)
    pages = pages.drop("host", "path", "rule", "verdict", "mined")
    names = pages.columns
    if isinstance(rules, DataFrame):
        return _verdicts(pages.join(_met(pages, rules), "url", "left").select(*names, "mined"), fixed)
    index = spark.sparkContext.broadcast(index_of(rules))  # MOST_RULES rules at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for url in texts_of(batch.column(names.index("url"))).to_pylist():
                have = set(items(url)) if index.value else set()
                hits = sorted(" ".join(sorted(r)) for i in have for r in index.value.get(i, ()) if r <= have)
                found.append(hits[0] if hits else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "mined"])

    return _verdicts(pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("mined", T.StringType())])), fixed)


def _verdicts(rows: DataFrame, fixed: tuple[tuple[str, str], ...]) -> DataFrame:
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    found = fixed_rule(F.col("host"), F.col("path"), fixed)
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.withColumns({"rule": found["rule"], "verdict": F.coalesce(found["verdict"], method)})


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and block of the pages that have labels."""
    objections = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("block"))
    return pages.join(objections, F.col("page_id") == F.col("doc_id")).select("url", "block")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = written(mined(labelled_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))), "rules")
    few = rules.limit(MOST_RULES + 1).count() <= MOST_RULES
    return judge(pages, _listed(rules) if few else rules).select("page_id", "host", "path", "rule", "verdict", "mined")


#: Rules of one and two items; the tests compare larger ones with a plain miner.
OP10_SQL = r"""
WITH u AS (SELECT page_id, url, regexp_matches(coalesce(url, ''), '(?s)://') AS there, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '(?s)^.*?://[^?#]*[?]([^#]*)', 1) AS q FROM pages),
i AS (SELECT page_id, url, 'host:' || x AS item FROM (SELECT page_id, url, unnest(string_split(h, '.')) AS x FROM u) WHERE x <> ''
  UNION SELECT page_id, url, 'path:' || lower(x) FROM (SELECT page_id, url, unnest(regexp_split_to_array(ltrim(p, '/'), '[^\p{L}\p{N}]+')) AS x FROM u) WHERE x <> '' AND NOT regexp_full_match(x, '\p{Nd}+')
  UNION SELECT page_id, url, 'ending:' || lower(regexp_extract(p, '[.]([\p{L}\p{N}_]{1,5})$', 1)) FROM u WHERE regexp_matches(p, '[.][\p{L}\p{N}_]{1,5}$')
  UNION SELECT page_id, url, 'query:' || lower(split_part(x, '=', 1)) FROM (SELECT page_id, url, unnest(string_split(q, '&')) AS x FROM u) WHERE x <> ''),
l AS (SELECT doc_id AS page_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS block FROM labels GROUP BY doc_id),
t AS (SELECT page_id, block FROM l JOIN pages USING (page_id)),
enough AS (SELECT greatest(20, ceil(0.002 * count(*))) AS n FROM t),
one AS (SELECT item AS a, item AS b FROM i JOIN t USING (page_id) GROUP BY item HAVING count_if(block) >= (SELECT n FROM enough) AND count_if(block) >= 0.6 * count(*)),
often AS (SELECT item FROM i JOIN t USING (page_id) GROUP BY item HAVING count_if(block) >= (SELECT n FROM enough) AND item NOT IN (SELECT a FROM one)),
two AS (SELECT x.item AS a, y.item AS b FROM i x JOIN i y ON x.page_id = y.page_id AND x.item < y.item JOIN t ON t.page_id = x.page_id WHERE x.item IN (SELECT item FROM often) AND y.item IN (SELECT item FROM often) GROUP BY 1, 2 HAVING count_if(block) >= (SELECT n FROM enough) AND count_if(block) >= 0.6 * count(*)),
hits AS (SELECT x.page_id, min(CASE WHEN a = b THEN a ELSE a || ' ' || b END) AS mined FROM i x JOIN (SELECT * FROM one UNION ALL SELECT * FROM two) r ON x.item = r.a JOIN i y ON y.page_id = x.page_id AND y.item = r.b GROUP BY x.page_id),
f AS (SELECT page_id, coalesce(h, '') AS host, coalesce(p, '') AS path, CASE
  WHEN (h = 'example.com' OR ends_with(h, '.example.com')) AND starts_with(p, '/en/7') THEN 'example.com/en/7'
  WHEN (h = 'example.net' OR ends_with(h, '.example.net')) AND starts_with(p, '/de/8') THEN 'example.net/de/8'
  WHEN (h = 'com' OR ends_with(h, '.com')) AND starts_with(p, '/en/') THEN 'com/en/'
  WHEN (h = 'net' OR ends_with(h, '.net')) AND starts_with(p, '/de/') THEN 'net/de/'
  WHEN (h = 'org' OR ends_with(h, '.org')) AND starts_with(p, '/es/') THEN 'org/es/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR mined IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined FROM f LEFT JOIN hits USING (page_id)
"""
