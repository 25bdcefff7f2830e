"""Virtual volumes made of the driver's tables, for queries that have no real volume to read.

Each projection exists twice: as a DataFrame here and, for the oracle, as SQL text in plans/oracles.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree
from ..schema import EPOCH, NODES
from ..storage import age, stored_at, there

CLUSTER = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(timestamp: str):
    return F.unix_micros(F.col(timestamp).cast("timestamp")) * 10 + EPOCH


def _node(rows: DataFrame, drive: str, record, parent, name, size=None, attributes=None, directory: bool = True, created=None, modified=None, source: str = "mft") -> DataFrame:
    size = F.lit(0) if size is None else size
    values = {
        "drive": F.lit(drive), "record_number": record, "parent_record_number": parent, "file_reference_number": record, "name": name, "file_size": size,
        "allocated_size": F.ceil(size / CLUSTER) * CLUSTER, "attributes": F.lit(16 if directory else 32) if attributes is None else attributes, "is_directory": F.lit(directory),
        "creation_time": F.lit(0) if created is None else created, "modification_time": F.lit(0) if modified is None else modified, "source": F.lit(source),
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in NODES.fields])


def warehouse_raw(spark: SparkSession, sf_dir: str, drive: str = "W") -> DataFrame:
    """Root, region, nation, customer and order directories, line item files. Some file names collide within an order."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda base, c: F.lit(base) + F.col(c)
    root = _node(spark.range(1), drive, F.lit(5), F.lit(5), F.lit("."))
    region = _node(t("region"), drive, key(100, "r_regionkey"), F.lit(5), F.col("r_name"))
    nation = _node(t("nation"), drive, key(1000, "n_nationkey"), key(100, "n_regionkey"), F.col("n_name"))
    customer = _node(t("customer"), drive, key(1_000_000, "c_custkey"), key(1000, "c_nationkey"), F.col("c_name"))
    orders = _node(t("orders"), drive, key(100_000_000, "o_orderkey"), key(1_000_000, "o_custkey"), F.concat(F.lit("order-"), F.col("o_orderkey")), created=ticks("o_orderdate"), modified=ticks("o_orderdate"))
    record = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") + 10_000_000_000
    ext = F.when(F.col("l_returnflag") == "A", ".log").when(F.col("l_returnflag") == "N", ".tar.gz").otherwise(".TXT")
    flags = F.lit(32) + F.when(F.col("l_suppkey") % 7 == 0, 2).otherwise(0) + F.when(F.col("l_partkey") % 11 == 0, 4).otherwise(0)
    files = _node(t("lineitem"), drive, record, key(100_000_000, "l_orderkey"), F.concat(F.lit("Line"), F.col("l_linenumber"), ext), F.round(F.col("l_extendedprice") * 100), flags, False, ticks("l_shipdate"), ticks("l_shipdate"))
    return root.unionByName(region).unionByName(nation).unionByName(customer).unionByName(orders).unionByName(files)


def documents(spark: SparkSession, sf_dir: str, drive: str = "D") -> DataFrame:
    """Root, language and source directories, document files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lang = F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))
    source = lang * 1000 + F.substring("source", 4, 9).cast("long") + 1_000_000_000
    root = _node(spark.range(1), drive, F.lit(5), F.lit(5), F.lit("."))
    langs = _node(docs.select("lang").distinct(), drive, lang, F.lit(5), F.col("lang"))
    sources = _node(docs.select("lang", "source").distinct(), drive, source, lang, F.col("source"))
    ext = F.element_at(F.array(*map(F.lit, ["txt", "PDF", "md", "log", "docx"])), (F.col("doc_id") % 5 + 1).cast("int"))
    files = _node(docs, drive, F.col("doc_id") + 10_000_000_000, source, F.concat(F.lit("doc"), F.col("doc_id"), F.lit("."), ext), F.col("n_chars"), directory=False)
    return root.unionByName(langs).unionByName(sources).unionByName(files)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files with a hard link in each order that has them: drive, record_number, parent_record_number, name, file_size."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct().join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _node(rows, "H", F.col("l_partkey"), F.col("l_orderkey") + 100_000_000, F.concat(F.lit("part"), F.col("l_partkey"), F.lit(".dll")), F.round(F.col("p_retailprice") * 100), directory=False)


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as paths: page_id, parent_path, name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    return pages.select("page_id", F.concat(F.lit("P:\\"), F.translate(F.regexp_extract(rest, "^(.*)/[^/]*$", 1), "/", "\\")).alias("parent_path"), F.regexp_extract(rest, "/([^/]*)$", 1).alias("name"))


#: Which reason bits an event stands for.
EVENT_BITS = {"signup": 0x100, "error": 0x200, "click": 0x1, "view": 0x400, "purchase": 0x8002}


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal records: drive, record_number, parent_record_number, name, reason_bits, attributes, usn, timestamp."""
    e = table(spark, sf_dir, "events")
    bits = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v).cast("long")) for k, v in EVENT_BITS.items()], F.lit(0).cast("long"))
    bits = bits + F.when(F.col("event_id") % 3 == 0, F.lit(0x80000000).cast("long")).otherwise(F.lit(0).cast("long"))
    return e.select(F.lit("E").alias("drive"), F.col("user_id").alias("record_number"), (F.col("user_id") % 10 + 100).alias("parent_record_number"), F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.col("event_id")).alias("name"), bits.alias("reason_bits"), F.lit(32).cast("long").alias("attributes"), F.col("event_id").alias("usn"), ticks("ts").alias("timestamp"))


_OPENED: dict[tuple, tuple[str, DataFrame, DataFrame]] = {}
_WAREHOUSE = ("region", "nation", "customer", "orders", "lineitem")


def opened(spark: SparkSession, sf_dir: str, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """The warehouse as an opened volume: its nodes, and its directories' chains and paths, written once to the shared folder.

    Like a scan that many searches follow. It is built again if a source file is another one or the session is, or on request.
    """
    key = (spark.sparkContext.applicationId, *((t, age(spark, f"{sf_dir}/{t}.parquet")) for t in _WAREHOUSE))
    path, nodes, chains = _OPENED.get(key, ("", None, None))
    if fresh or not path or not there(spark, path):
        nodes = tree.cut_lineage(tree.dedup(warehouse_raw(spark, sf_dir)))
        chains = tree.cut_lineage(tree.directory_chains(nodes))
        _OPENED[key] = nodes._arbordex_path, nodes, chains
        return nodes, chains
    # Other DataFrame objects each time: a plan that was run isn't run again.
    return stored_at(spark, path, nodes.schema), stored_at(spark, chains._arbordex_path, chains.schema)
