"""The registered queries over the reference surface: name -> (function of spark and a data folder, DuckDB SQL or None)."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import tables
from ..operators import extents, merge, search, sinks, tree, treemap
from ..operators.search import SearchSpec
from ..sources import layouts, scan, volumes
from ..storage import shared_folder
from ..streaming import journal
from . import oracles as sql

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_ID = ["record_number", "parent_record_number", "name"]
_IDS = ", ".join(_ID)


def query(oracle: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, oracle)
        return f

    return add


def warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the opened volume."""
    return volumes.opened(spark, sf_dir)[0]


def _warehouse_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_paths(*volumes.opened(spark, sf_dir))


# --- filters --------------------------------------------------------------------------------------------------------------


@query(sql.w(f"SELECT drive, {_IDS} FROM w WHERE name <> '' AND contains(lower(name), 'der-12') ORDER BY record_number, parent_record_number, name LIMIT 100"))
def fl01_substring(spark, sf):
    return search.substring_search(warehouse(spark, sf), "DER-12").select("drive", *_ID)


@query(sql.w(f"SELECT {_IDS} FROM w WHERE name <> '' AND contains(lower(name), 'line3.log') ORDER BY drive, record_number, parent_record_number, name LIMIT 100"))
def fl02_glob(spark, sf):
    return search.glob_search(warehouse(spark, sf), "*line3?.log*").select(*_ID)


@query(f"WITH {sql.PAGES} SELECT page_id, name, starts_with(lower(name), '1') AS head, ends_with(lower(name), '.html') AS tail, contains(lower(name), 'page=') AS middle, true AS everything, contains(lower(name), '5?p') AS literal_mark, contains(lower(name), '1*2') AS literal_star FROM p")
def fl03_wildcards(spark, sf):
    n = F.lower("name")
    marks = {"head": "1*", "tail": "*.html", "middle": "*page=*", "everything": "**", "literal_mark": "5?p", "literal_star": "1*2"}
    return volumes.page_names(spark, sf).select("page_id", "name", *[search.wildcard(n, p).alias(k) for k, p in marks.items()])


@query(sql.w(f"SELECT {_IDS} FROM w WHERE name <> '' AND (ends_with(lower(name), '.log') OR starts_with(lower(name), 'order-77'))"))
def fl04_multi(spark, sf):
    return search.search(warehouse(spark, sf), SearchSpec("*.LOG; order-77* ;")).select(*_ID)


@query(sql.w(f"SELECT {_IDS} FROM w WHERE false"))
def fl04_only_separators(spark, sf):
    return search.search(warehouse(spark, sf), SearchSpec(";")).select(*_ID)


@query(sql.dirs(f"SELECT w.record_number, w.parent_record_number, w.name, d.p AS parent_path FROM w JOIN d ON w.parent_record_number = d.record_number WHERE starts_with(lower(d.p), 'w:\\asia\\nation_1') AND contains(lower(w.name), 'line1')"))
def fl05_scope(spark, sf):
    return search.search(_warehouse_with_parents(spark, sf), SearchSpec("`W:\\Asia\\NATION_1` line1")).select(*_ID, "parent_path")


@query(sql.w(f"SELECT {_IDS} FROM w WHERE name <> '' AND regexp_matches(name, '^Line[1-3][.](log|TXT)$')"))
def fl06_regex(spark, sf):
    return search.search(warehouse(spark, sf), SearchSpec(regex=r"^Line[1-3]\.(?P<kind>log|TXT)$")).select(*_ID)


_DAY = 864000000000


@query(sql.w(f"SELECT {_IDS} FROM w WHERE name <> '' AND modification_time <> 0 AND modification_time BETWEEN {sql.EPOCH} + 9131 * {_DAY} AND {sql.EPOCH} + 9162 * {_DAY}"))
def fl07_date(spark, sf):
    return search.search(warehouse(spark, sf), SearchSpec(date_mode="Between", date_start="1995-01-01", date_end="1995-02-01")).select(*_ID)


@query(sql.w(f"SELECT {_IDS}, file_size FROM w WHERE name <> '' AND file_size > 10224640"))
def fl08_size(spark, sf):
    return search.search(warehouse(spark, sf), SearchSpec(size_mode=">", size_start="9985KB")).select(*_ID, "file_size")


@query(sql.w(f"SELECT {_IDS} FROM w WHERE {sql.EXT.format('name')} IN ('txt', 'log')"))
def fl09_ext(spark, sf):
    return search.search(warehouse(spark, sf), SearchSpec(extensions="TXT; log ;")).select(*_ID)


@query(sql.dirs(f"SELECT w.record_number, w.parent_record_number, w.name FROM w JOIN d ON w.parent_record_number = d.record_number WHERE starts_with(lower(d.p), 'w:\\europe') AND contains(lower(w.name), 'line') AND regexp_matches(w.name, '[24]') AND w.modification_time <> 0 AND w.modification_time >= {sql.EPOCH} + 9131 * {_DAY} AND w.file_size < 5242880 AND {sql.EXT.format('w.name')} IN ('gz')"))
def fl10_combined(spark, sf):
    spec = SearchSpec("`w:\\europe` line", regex="[24]", date_mode="After", date_start="1995-01-01", size_mode="<", size_start="5 MB", extensions="gz")
    return search.search(_warehouse_with_parents(spark, sf), spec).select(*_ID)


@query(sql.w(f"SELECT {_IDS} FROM w WHERE attributes & 2 = 0 AND attributes & 4 = 0"))
def fl11_hidden(spark, sf):
    return search.visible(warehouse(spark, sf)).select(*_ID)


@query(sql.w(f"SELECT {_IDS} FROM w WHERE name <> '' AND is_directory"))
def fl13_folder(spark, sf):
    return search.search(warehouse(spark, sf), search.preset("folder:")).select(*_ID)


@query(sql.w(f"SELECT {_IDS} FROM w WHERE {sql.EXT.format('name')} IN ('bat', 'exe', 'gz') AND file_size >= 1048576 AND file_size <= 2097152"))
def fl14_presets(spark, sf):
    base = SearchSpec(size_mode="Between", size_start="1MB", size_end="2MB")
    return search.search(warehouse(spark, sf), search.preset("ext:bat;exe;gz", base)).select(*_ID)


@query(sql.w("SELECT record_number, name, attributes & 2 <> 0 AS hidden, attributes & 4 <> 0 AS system, attributes & 16 <> 0 AS directory, attributes & 1 <> 0 AS readonly, attributes & 32 <> 0 AS archive FROM w"))
def fl15_attributes(spark, sf):
    bits = {k: fn.has_attribute(F.col("attributes"), v).alias(k) for k, v in search.ATTRIBUTES.items() if k in ("hidden", "system", "directory", "readonly", "archive")}
    return warehouse(spark, sf).select("record_number", "name", *bits.values())


@query(sql.w(f"SELECT record_number, name, CASE WHEN is_directory OR file_size = 0 THEN '' ELSE {sql.SIZE_TEXT.format('file_size')} END AS size_text, CASE WHEN modification_time = 0 THEN '' ELSE strftime(make_timestamp({sql.UNIX.format('modification_time')} * 1000000), '%Y-%m-%d %H:%M:%S') END AS date_text, CASE WHEN is_directory THEN 'Folder' WHEN {sql.EXT.format('name')} = 'log' THEN 'Log File' WHEN {sql.EXT.format('name')} = 'txt' THEN 'Text File' WHEN {sql.EXT.format('name')} = 'gz' THEN 'GZip Archive' ELSE 'File' END AS type_label FROM w"))
def pj03_display(spark, sf):
    return search.display(warehouse(spark, sf)).select("record_number", "name", "size_text", "date_text", "type_label")


# --- sorting and top-k -----------------------------------------------------------------------------------------------------


def _type(ext: str) -> str:
    return f"CASE WHEN is_directory THEN 'Folder' WHEN {ext} = 'log' THEN 'Log File' WHEN {ext} = 'txt' THEN 'Text File' WHEN {ext} = 'gz' THEN 'GZip Archive' ELSE 'File' END"


@query(sql.w(f"SELECT {_IDS} FROM w ORDER BY {_type(sql.EXT.format('name'))} DESC, drive, record_number, parent_record_number, name LIMIT 50 OFFSET 10"))
def so01_sort_type_topn(spark, sf):
    return search.page(search.sort_by(warehouse(spark, sf), "type", True), 10, 50).select(*_ID)


@query(sql.dirs("SELECT w.record_number, w.name, d.p AS parent_path FROM w JOIN d ON w.parent_record_number = d.record_number WHERE w.record_number <> 5 ORDER BY lower(d.p) || '\\' || lower(w.name), w.record_number"))
def so01_sort_path(spark, sf):
    """Every row, sorted."""
    rows = tree.edges(_warehouse_with_parents(spark, sf))
    rows = rows.withColumn("parent_path", F.rtrim("parent_path", F.lit("\\")))
    return search.sort_by(rows, "path").select("record_number", "name", "parent_path")


@query(sql.w(f"SELECT {_IDS}, file_size FROM w WHERE NOT is_directory AND name <> '' ORDER BY file_size DESC, record_number, parent_record_number, name LIMIT 20"))
def tk01_largest_files(spark, sf):
    return search.largest_files(warehouse(spark, sf)).select(*_ID, "file_size")


@query(sql.rolled(f"SELECT 'W' AS drive, rolled.record_number, CASE WHEN rolled.record_number = 5 THEN 'W:\\' ELSE d.p END AS path, total_size, {sql.SIZE_TEXT.format('total_size')} AS size_text, file_count, dir_count FROM rolled JOIN d ON d.record_number = rolled.record_number ORDER BY total_size DESC, rolled.record_number LIMIT 20"))
def tk02_largest_dirs(spark, sf):
    nodes, chains = volumes.opened(spark, sf)
    top = tree.largest_directories(tree.rollup(nodes, chains))
    return tree.with_paths(top, chains).select("drive", "record_number", "path", "total_size", fn.format_size(F.col("total_size")).alias("size_text"), "file_count", "dir_count")


@query(sql.rolled(", k AS (SELECT *, row_number() OVER (PARTITION BY parent_record_number ORDER BY total_size DESC, record_number, name) AS rank FROM rolled WHERE record_number <> 5), t AS (SELECT record_number, name, total_size, CAST(1 AS BIGINT) AS rank, 0 AS depth FROM rolled WHERE record_number = 5 UNION ALL SELECT k.record_number, k.name, k.total_size, k.rank, t.depth + 1 FROM k JOIN t ON k.parent_record_number = t.record_number WHERE k.is_directory AND k.rank <= 10 AND t.depth < 3) SELECT record_number, name, total_size, rank, depth FROM t").replace("rolled AS (", "rolled AS MATERIALIZED ("))
def tk03_tree_size(spark, sf):
    nodes, chains = volumes.opened(spark, sf)
    shown = tree.tree_size(tree.rollup(nodes, chains), chains)
    return shown.select("record_number", "name", "total_size", F.col("rank").cast("long").alias("rank"), "depth")


@query(sql.rolled("SELECT parent_record_number, record_number, name, total_size, rank FROM (SELECT *, row_number() OVER (PARTITION BY parent_record_number ORDER BY total_size DESC, record_number, name) AS rank FROM rolled WHERE record_number <> 5) WHERE rank <= 3"))
def tk04_top_children(spark, sf):
    top = tree.top_children(tree.rollup(*volumes.opened(spark, sf)), 3)
    return top.select("parent_record_number", "record_number", "name", "total_size", F.col("rank").cast("long").alias("rank"))


# --- aggregation -----------------------------------------------------------------------------------------------------------


@query(sql.rolled("SELECT record_number, parent_record_number, total_size, total_allocated, file_count, dir_count FROM rolled"))
def ag01_rollup(spark, sf):
    return tree.rollup(*volumes.opened(spark, sf)).select("record_number", "parent_record_number", "total_size", "total_allocated", F.col("file_count").cast("long").alias("file_count"), F.col("dir_count").cast("long").alias("dir_count"))


_LOST = "o AS (SELECT * FROM w WHERE NOT (record_number BETWEEN 100000000 AND 9999999999 AND (record_number - 100000000) % 97 = 0))"


def _with_orphans(spark, sf):
    """The warehouse without some orders, whose files are orphans then."""
    n = F.col("record_number")
    return warehouse(spark, sf).where(~(n.between(100_000_000, 9_999_999_999) & ((n - 100_000_000) % 97 == 0)))


@query(sql.w(f", {_LOST} SELECT 'W' AS drive, CAST(count_if(NOT is_directory) AS BIGINT) AS files, CAST(count_if(is_directory) AS BIGINT) AS directories, CAST(sum(CASE WHEN is_directory THEN 0 ELSE file_size END) AS BIGINT) AS total_size, CAST(sum(CASE WHEN is_directory THEN 0 ELSE allocated_size END) AS BIGINT) AS total_allocated, CAST(count_if(parent_record_number NOT IN (0, 5) AND parent_record_number NOT IN (SELECT record_number FROM o)) AS BIGINT) AS orphaned FROM o"))
def ag02_stats(spark, sf):
    return tree.stats(_with_orphans(spark, sf)).select("drive", "files", "directories", "total_size", "total_allocated", "orphaned")


@query(sql.w("SELECT CAST(2 AS BIGINT) AS volumes, CAST(count_if(NOT is_directory) + (SELECT count(*) FROM documents) AS BIGINT) AS files, CAST(sum(CASE WHEN is_directory THEN 0 ELSE file_size END) + (SELECT sum(n_chars) FROM documents) AS BIGINT) AS total_size FROM w"))
def ag03_totals(spark, sf):
    both = merge.union_volumes([warehouse(spark, sf), volumes.documents(spark, sf)])
    return tree.totals(tree.stats(both)).select("volumes", "files", "total_size")


@query(f"WITH {sql.JOURNAL} SELECT drive, CAST(count_if(attributes & 16 = 0) AS BIGINT) AS files, CAST(count_if(attributes & 16 <> 0) AS BIGINT) AS directories, CAST(count(*) AS BIGINT) AS total, max(record_number) AS max_record FROM j GROUP BY drive")
def ag04_usn_counts(spark, sf):
    rows = volumes.journal(spark, sf).withColumn("is_directory", F.col("attributes").bitwiseAND(F.lit(16)) != 0)
    return merge.usn_counts(rows)


@query(f"WITH {sql.LINKS} SELECT record_number, CAST(count(*) AS BIGINT) AS links, min(parent_record_number) AS first_parent, max(parent_record_number) AS last_parent FROM h GROUP BY record_number HAVING count(*) >= 2")
def ag08_hardlinks(spark, sf):
    found = merge.hard_links(volumes.links(spark, sf))
    return found.select("record_number", "links", F.element_at("link_list", 1)["parent_record_number"].alias("first_parent"), F.element_at("link_list", -1)["parent_record_number"].alias("last_parent"))


def _runs(spark, sf):
    """Parts as data runs of one table: their sizes are clusters, every seventh is sparse."""
    p = volumes.table(spark, sf, "part")
    return p.select(F.lit("R").alias("drive"), F.col("p_partkey").alias("seq"), (F.col("p_partkey") * 1000).alias("lcn"), F.col("p_size").cast("long").alias("clusters"), (F.col("p_partkey") % 7 == 0).alias("sparse"))


_EXTENTS = "e AS (SELECT * FROM (SELECT p_partkey AS seq, p_partkey * 1000 AS lcn, CAST(p_size AS BIGINT) AS clusters, p_partkey % 7 = 0 AS sparse, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS vcn FROM part) WHERE NOT sparse)"


@query(f"WITH {_EXTENTS} SELECT seq, lcn, clusters, vcn, vcn * 4 AS start_record, (vcn + clusters) * 4 - 1 AS end_record FROM e")
def ag10_extents(spark, sf):
    return extents.coverage(extents.extent_map(_runs(spark, sf)), 4096, 1024).select("seq", "lcn", "clusters", "vcn", "start_record", "end_record")


# --- joins ------------------------------------------------------------------------------------------------------------------


@query(sql.w("SELECT w.record_number, w.parent_record_number, w.name, p.name AS parent_name FROM w JOIN w p ON w.parent_record_number = p.record_number AND p.is_directory WHERE w.record_number <> 5"))
def jn01_children(spark, sf):
    return tree.linked(warehouse(spark, sf)).select(*_ID, "parent_name")


@query(sql.w(f", {_LOST} SELECT {_IDS} FROM o WHERE parent_record_number NOT IN (0, 5) AND parent_record_number NOT IN (SELECT record_number FROM o)"))
def jn02_orphans(spark, sf):
    return tree.orphans(_with_orphans(spark, sf)).select(*_ID)


_MERGE_NEW = "CASE WHEN record_number % 3 = 0 THEN 0 ELSE modification_time + 1 END"


@query(sql.w(f", a AS (SELECT * FROM w WHERE record_number % 5 <> 0), b AS (SELECT * REPLACE (file_size * 2 AS file_size, {_MERGE_NEW} AS modification_time, 'new' || name AS name) FROM w WHERE record_number % 5 <> 1) SELECT coalesce(a.record_number, b.record_number) AS record_number, coalesce(a.parent_record_number, b.parent_record_number) AS parent_record_number, coalesce(a.name, b.name) AS name, coalesce(b.file_size, a.file_size) AS file_size, coalesce(nullif(b.modification_time, 0), a.modification_time, b.modification_time) AS modification_time FROM a FULL JOIN b ON a.record_number = b.record_number AND a.parent_record_number = b.parent_record_number"))
def jn03_merge(spark, sf):
    nodes = warehouse(spark, sf)
    new = nodes.where("record_number % 5 <> 1").withColumns({"file_size": F.col("file_size") * 2, "modification_time": F.when(F.col("record_number") % 3 == 0, 0).otherwise(F.col("modification_time") + 1), "name": F.concat(F.lit("new"), F.col("name"))})
    return merge.upsert(nodes.where("record_number % 5 <> 0"), new).select(*_ID, "file_size", "modification_time")


@query(f"WITH {sql.LINKS} SELECT record_number, parent_record_number, name, file_size FROM h")
def jn05_expand(spark, sf):
    rows = volumes.links(spark, sf)
    entries = rows.groupBy("record_number").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "record_number"]), "parent_record_number").alias("r"), F.collect_list(F.struct(F.col("parent_record_number").alias("parent"), "name")).alias("links"))
    entries = entries.select("record_number", "r.*", "links").select(*rows.columns, "links")
    return merge.expand_links(entries).select(*_ID, "file_size")


@query(f"WITH {sql.LINKS} SELECT record_number, parent_record_number, CAST(round(p_retailprice * 100) AS BIGINT) + p_size AS file_size, CASE WHEN p_size % 2 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS modification_time FROM h JOIN part ON record_number = p_partkey")
def jn06_propagate(spark, sf):
    size = F.col("p_size").cast("long")
    zero = F.lit(0).cast("long")
    updates = volumes.table(spark, sf, "part").select(F.lit("H").alias("drive"), F.col("p_partkey").alias("record_number"), (F.round(F.col("p_retailprice") * 100).cast("long") + size).alias("file_size"), zero.alias("allocated_size"), zero.alias("file_reference_number"), zero.alias("creation_time"), F.when(size % 2 == 0, 0).otherwise(size).alias("modification_time"))
    return merge.propagate(volumes.links(spark, sf), updates).select("record_number", "parent_record_number", "file_size", "modification_time")


@query(sql.dirs("SELECT w.record_number, w.name, CASE WHEN w.record_number = 5 THEN 'W:\\' ELSE d.p || '\\' || w.name END AS path, CASE WHEN w.record_number = 5 THEN 0 ELSE d.depth + 1 END AS depth, true AS path_complete FROM w JOIN d ON w.parent_record_number = d.record_number"))
def jn08_paths(spark, sf):
    return _warehouse_with_parents(spark, sf).select("record_number", "name", "path", "depth", "path_complete")


@query(f"WITH {_EXTENTS}, q AS (SELECT l_orderkey * 7 + l_linenumber AS record_number FROM lineitem) SELECT record_number, coalesce((e.lcn + record_number // 4 - e.vcn) * 4096 + record_number % 4 * 1024, CAST(786432 AS BIGINT) * 4096 + record_number * 1024) AS byte_offset FROM q LEFT JOIN e ON record_number // 4 >= e.vcn AND record_number // 4 < e.vcn + e.clusters")
def jn09_extent_lookup(spark, sf):
    rows = volumes.table(spark, sf, "lineitem").select(F.lit("R").alias("drive"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("record_number"))
    found = extents.record_offsets(rows, extents.extent_map(_runs(spark, sf)), 786432, 4096, 1024)
    return found.select("record_number", F.col("byte_offset").cast("long").alias("byte_offset"))


# --- set operations ----------------------------------------------------------------------------------------------------------


@query(sql.w("SELECT drive, record_number, name FROM w UNION ALL SELECT 'D', doc_id + 10000000000, 'doc' || doc_id || '.' || ['txt', 'PDF', 'md', 'log', 'docx'][doc_id % 5 + 1] FROM documents"))
def st01_union(spark, sf):
    nodes = warehouse(spark, sf)
    again = volumes.warehouse_raw(spark, sf).withColumn("name", F.lit("ignored"))
    both = merge.union_volumes([nodes, volumes.documents(spark, sf), again])
    return both.where("drive = 'W' OR NOT is_directory").select("drive", "record_number", "name")


@query(sql.w(f"SELECT {_IDS}, file_size FROM w"))
def st02_dedup(spark, sf):
    return tree.dedup(volumes.warehouse_raw(spark, sf)).select(*_ID, "file_size")


# --- scalar functions --------------------------------------------------------------------------------------------------------

_SIZES = "s AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1000 WHEN 4 THEN 1000000 ELSE 7 END AS b FROM lineitem)"


@query(f"WITH {_SIZES} SELECT l_orderkey, l_linenumber, b, {sql.SIZE_TEXT.format('b')} AS size_text FROM s")
def fn01_format_size(spark, sf):
    n = F.col("l_linenumber")
    scale = F.when(n == 1, 0).when(n == 2, 1).when(n == 3, 1000).when(n == 4, 1000000).otherwise(7)
    rows = volumes.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.round(F.col("l_extendedprice") * 100).cast("long") * scale).alias("b"))
    return rows.withColumn("size_text", fn.format_size(F.col("b")))


@query(f"WITH t AS (SELECT event_id, epoch_us(ts) * 10 + {sql.EPOCH} - CASE WHEN event_id % 100 = 0 THEN {sql.EPOCH} ELSE 0 END AS f FROM events) SELECT event_id, f AS ticks, CAST({sql.UNIX.format('f')} AS BIGINT) AS unix, strftime(make_timestamp({sql.UNIX.format('f')} * 1000000), '%Y-%m-%d %H:%M:%S') AS text FROM t")
def fn02_filetime(spark, sf):
    rows = volumes.table(spark, sf, "events").select("event_id", (volumes.ticks("ts") - F.when(F.col("event_id") % 100 == 0, fn.EPOCH).otherwise(0)).alias("ticks"))
    return rows.select("event_id", "ticks", fn.filetime_to_unix(F.col("ticks")).alias("unix"), fn.format_filetime(F.col("ticks")).alias("text"))


@query("WITH t AS (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part) SELECT p_partkey, p_size || ['MB', ' kb', '', 'K', ' B', '.5 gb'][k + 1] AS text, CAST(CASE k WHEN 0 THEN p_size * 1048576 WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size WHEN 3 THEN NULL WHEN 4 THEN p_size ELSE (p_size + 0.5) * 1073741824 END AS BIGINT) AS bytes FROM t")
def fn04_parse_size(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ["MB", " kb", "", "K", " B", ".5 gb"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = volumes.table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("text"))
    return rows.withColumn("bytes", fn.parse_size_column(F.col("text")))


@query(f"WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-') || '31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders) SELECT o_orderkey, text, CAST(epoch_us(try_strptime(text, '%Y-%m-%d')) * 10 + {sql.EPOCH} AS BIGINT) AS ticks FROM t")
def fn05_parse_date(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 3, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.concat(F.date_format(d, "yyyy-MM-"), F.lit("31"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return volumes.table(spark, sf, "orders").select("o_orderkey", text.alias("text"), fn.parse_date_column(text).alias("ticks"))


@query(f"WITH {sql.PAGES} SELECT page_id, name, {sql.EXT.format('name')} AS extension, lower(CASE WHEN contains(name, '.') THEN regexp_extract(name, '([^.]*)$', 1) ELSE name END) AS last_part FROM p")
def fn08_extension(spark, sf):
    return volumes.page_names(spark, sf).select("page_id", "name", fn.extension(F.col("name")).alias("extension"), fn.last_part(F.col("name")).alias("last_part"))


_DOC_EXT = "['txt', 'pdf', 'md', 'log', 'docx'][doc_id % 5 + 1]"


@query(f"SELECT doc_id, ['Text File', 'PDF Document', 'Markdown', 'Log File', 'Word Document'][doc_id % 5 + 1] AS type_label, ['Gray', 'LightYellow', 'Gray', 'Gray', 'LightYellow'][doc_id % 5 + 1] AS colour, ['📝', '📕', '📃', '📝', '📄'][doc_id % 5 + 1] AS icon, ['120,120,120', '200,50,50', '120,120,120', '120,120,120', '55,130,200'][doc_id % 5 + 1] AS fill FROM documents")
def fn10_type_label(spark, sf):
    rows = volumes.documents(spark, sf).where("NOT is_directory")
    ext, d = fn.extension(F.col("name")), F.col("is_directory")
    return rows.select((F.col("record_number") - 10_000_000_000).alias("doc_id"), tables.type_label(d, ext).alias("type_label"), tables.name_colour(ext).alias("colour"), tables.icon(d, ext).alias("icon"), fn.leaf_colour(F.col("name"), d, F.lit(0)).alias("fill"))


@query("SELECT p_partkey, p_brand, CAST(list_reduce(list_prepend(0::BIGINT, [ord(substr(lower(p_brand), i, 1))::BIGINT for i in range(1, length(lower(p_brand)) + 1)]), lambda a, b: (a * 31 + b) % 4294967296) % 360 AS INTEGER) AS hue FROM part")
def fn14_hue(spark, sf):
    return volumes.table(spark, sf, "part").select("p_partkey", "p_brand", fn.extension_hue(F.lower("p_brand")).alias("hue"))


@query("SELECT p_partkey, p_size, p_partkey + p_size * 281474976710656 AS reference, p_partkey AS record FROM part")
def fn17_frn(spark, sf):
    reference = fn.reference_of(F.col("p_partkey"), F.col("p_size"))
    return volumes.table(spark, sf, "part").select("p_partkey", "p_size", reference.alias("reference"), fn.record_of(reference).alias("record"))


@query(f"WITH {sql.JOURNAL} SELECT usn, reason_bits, reason FROM r")
def fn19_reason(spark, sf):
    return volumes.journal(spark, sf).select("usn", "reason_bits", fn.classify_reason(F.col("reason_bits")).alias("reason"))


@query(f"WITH {sql.PAGES} SELECT page_id, parent_path || '\\' || name AS path, parent_path AS parent FROM p")
def fn20_parent_dir(spark, sf):
    path = F.concat(F.col("parent_path"), F.lit("\\"), F.col("name"))
    return volumes.page_names(spark, sf).select("page_id", path.alias("path"), fn.parent_dir(path).alias("parent"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 12 THEN c_name ELSE left(c_name, 11) || '…' END AS short, rpad(c_name, 24, ' ') AS padded FROM customer")
def fn21_fit(spark, sf):
    return volumes.table(spark, sf, "customer").select("c_custkey", fn.shortened(F.col("c_name"), 12).alias("short"), fn.padded(F.col("c_name"), 24).alias("padded"))


# --- decoders: the driver's columns are packed and decoded again; the oracle is the columns ---------------------------------------


def _packed(rows: DataFrame, pack, schema: str = scan.RAW) -> DataFrame:
    """rows through a function of one row that gives (drive, record_number, data)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for r in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True) for x in pack(*r)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["drive", "record_number", "data"])

    return rows.mapInArrow(run, schema)


def _part_record(key: int, name: str, size: int, price: int) -> list[tuple]:
    runs = [(size, key * 100, False), (3, 0, True), (size + 1, key * 50, False)]
    data = layouts.pack_attribute(layouts.DATA, runs=runs, size=price, allocated=price + 4096) if key % 2 else layouts.pack_attribute(layouts.DATA, b"x" * (size % 100))
    names = [layouts.pack_name(5, "SHORT~1", layouts.DOS), layouts.pack_name(key % 7 + 100, f"{name}-{key}", layouts.WIN32, 11, 12)]
    return [("C", key, layouts.pack_record([layouts.pack_times(key % 3, 0, 32), *names, data], sequence=size))]


def _part_records(spark, sf):
    return _packed(volumes.table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("price")), _part_record)


@query("SELECT p_partkey AS record_number, p_partkey % 7 + 100 AS parent_record_number, p_name || '-' || p_partkey AS name, CASE WHEN p_partkey % 2 = 1 THEN CAST(round(p_retailprice * 100) AS BIGINT) ELSE p_size % 100 END AS file_size, CASE WHEN p_partkey % 2 = 1 THEN CAST(round(p_retailprice * 100) AS BIGINT) + 4096 ELSE 0 END AS allocated_size, CAST(32 AS BIGINT) AS attributes, CASE WHEN p_partkey % 3 = 0 THEN 11 ELSE p_partkey % 3 END AS creation_time, CAST(12 AS BIGINT) AS modification_time, p_partkey + p_size * 281474976710656 AS file_reference_number FROM part")
def dc03_mft_roundtrip(spark, sf):
    nodes = scan.scan(_part_records(spark, sf))
    return nodes.select("record_number", "parent_record_number", "name", "file_size", "allocated_size", "attributes", "creation_time", "modification_time", "file_reference_number")


@query("WITH t AS (SELECT p_partkey, unnest([{'c': CAST(p_size AS BIGINT), 'l': p_partkey * 100, 's': false}, {'c': 3, 'l': 0, 's': true}, {'c': p_size + 1, 'l': p_partkey * 50, 's': false}]) AS r FROM part WHERE p_partkey % 2 = 1) SELECT p_partkey AS record_number, CAST(r.c AS BIGINT) AS clusters, CAST(r.l AS BIGINT) AS lcn, r.s AS sparse FROM t")
def dc11_runs_roundtrip(spark, sf):
    return scan.decode_records(_part_records(spark, sf)).select("record_number", F.inline("runs"))


def _extended_record(order: int, customer: int) -> list[tuple]:
    base, extension = 2 * order, 2 * order + 1
    listed = layouts.pack_list([(layouts.FILE_NAME, 0, extension), (layouts.DATA, 0, extension)])
    own = [layouts.pack_name(customer, f"own{order}")] if order % 3 else []
    more = [layouts.pack_name(customer + 1, f"far{order}"), layouts.pack_attribute(layouts.DATA, runs=[(1, 5, False)], size=order, allocated=4096)]
    return [("C", base, layouts.pack_record([listed, *own])), ("C", extension, layouts.pack_record(more, base=base))]


@query("SELECT 2 * o_orderkey AS record_number, o_custkey AS parent_record_number, 'own' || o_orderkey AS name, o_orderkey AS file_size FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 2 * o_orderkey, o_custkey + 1, 'far' || o_orderkey, o_orderkey FROM orders")
def dc13_extensions(spark, sf):
    rows = _packed(volumes.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), _extended_record)
    return scan.scan(rows).select(*_ID, "file_size")


@query(f"WITH {sql.JOURNAL} SELECT record_number, parent_record_number, usn, \"timestamp\", reason_bits, attributes, name FROM j")
def dc18_usn_roundtrip(spark, sf):
    def pack(record, parent, name, usn, time, bits, attributes):
        return [("E", 0, struct.pack("<Q", usn + 1) + layouts.pack_usn(record, parent, name, usn, time, bits, attributes, 2 + usn % 2))]

    rows = volumes.journal(spark, sf).select("record_number", "parent_record_number", "name", "usn", "timestamp", "reason_bits", "attributes")
    return scan.decode_pages(_packed(rows, pack)).select("record_number", "parent_record_number", "usn", "timestamp", "reason_bits", "attributes", "name")


@query("SELECT s_suppkey, CAST(512 * [1, 2, 4, 8][s_suppkey % 4 + 1] AS BIGINT) AS bytes_per_cluster, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1024 ELSE 512 * [1, 2, 4, 8][s_suppkey % 4 + 1] END AS BIGINT) AS bytes_per_record, s_suppkey * 1000 AS total_sectors FROM supplier")
def sc13_boot_roundtrip(spark, sf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            found = [layouts.boot_sector(layouts.pack_boot(512, [1, 2, 4, 8][k % 4], k * 1000, record=1 if k % 2 else -10)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array([f[c] for f in found], pa.int64()) for c in ("bytes_per_cluster", "bytes_per_record", "total_sectors")]], names=["s_suppkey", "bytes_per_cluster", "bytes_per_record", "total_sectors"])

    return volumes.table(spark, sf, "supplier").select("s_suppkey").mapInArrow(run, "s_suppkey long, bytes_per_cluster long, bytes_per_record long, total_sectors long")


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 << (s_suppkey % 12) ELSE (s_suppkey % 12) * 4096 END AS BIGINT) AS bytes_per_record FROM supplier")
def fn24_record_bytes(spark, sf):
    k = (F.col("s_suppkey") % 12).cast("int")
    return volumes.table(spark, sf, "supplier").select("s_suppkey", F.when((F.col("s_suppkey") % 2 == 0) & (k == 0), 1).otherwise(fn.bytes_per_record(F.when(F.col("s_suppkey") % 2 == 0, -k).otherwise(k), F.lit(4096))).cast("long").alias("bytes_per_record"))


@query(f"WITH {sql.JOURNAL} SELECT record_number, max(usn) AS usn, max_by(name, usn) AS name FROM j GROUP BY record_number")
def sc08_last_rows(spark, sf):
    return merge.last_rows(volumes.journal(spark, sf)).select("record_number", "usn", "name")


@query(f"WITH {sql.LINKS} SELECT record_number, parent_record_number, CASE WHEN record_number % 4 = 0 THEN record_number * 3 ELSE file_size END AS file_size, allocated_size FROM h")
def sc18_refresh(spark, sf):
    overlay = volumes.table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("file_reference_number"), (F.col("p_partkey") * 3).alias("file_size"), F.lit(0).cast("long").alias("creation_time"), F.lit(0).cast("long").alias("modification_time"))
    return merge.refresh(volumes.links(spark, sf), overlay).select("record_number", "parent_record_number", "file_size", "allocated_size")


# --- journal ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {sql.JOURNAL} SELECT usn, record_number, name, reason, reason_bits FROM c")
def sr02_changes(spark, sf):
    return journal.changes(volumes.journal(spark, sf)).select("usn", "record_number", "name", "reason", "reason_bits")


@query(f"WITH {sql.JOURNAL}, b AS (SELECT record_number, max(CASE WHEN reason IN ('Created', 'Deleted') THEN usn END) AS born FROM c GROUP BY 1) SELECT c.record_number, max_by(name, usn) FILTER (reason <> 'RenamedFrom') AS name, coalesce(max_by(reason <> 'Deleted', usn) FILTER (reason IN ('Created', 'Deleted')), true) AS \"exists\", coalesce(bool_or(reason IN ('Modified', 'AttributeChange', 'SecurityChange', 'Other') AND usn > coalesce(born, -1)), false) AS needs_refresh, max(usn) AS last_usn FROM c JOIN b USING (record_number) GROUP BY 1")
def sr03_state(spark, sf):
    return journal.fold(volumes.journal(spark, sf)).select("record_number", "name", "exists", "needs_refresh", "last_usn")


@query(f"WITH {sql.JOURNAL} SELECT record_number, min_by(name, usn) AS name, min(usn) AS last_usn FROM c WHERE reason = 'Created' GROUP BY 1")
def sr03_created_only(spark, sf):
    return journal.fold(volumes.journal(spark, sf), created_only=True).select("record_number", "name", "last_usn")


@query(f"WITH {sql.JOURNAL} SELECT drive, max(usn) + 1 AS next_usn FROM j GROUP BY drive")
def sr05_next(spark, sf):
    return journal.next_usn(volumes.journal(spark, sf))


# --- traces, exports, layout ----------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {sql.W}, t AS (SELECT 0 AS step, record_number, parent_record_number, name FROM (SELECT * FROM w WHERE NOT is_directory ORDER BY record_number LIMIT 1) UNION ALL SELECT t.step + 1, w.record_number, w.parent_record_number, w.name FROM w JOIN t ON w.record_number = t.parent_record_number WHERE t.record_number <> 5 AND w.is_directory) SELECT step, record_number, parent_record_number, name FROM t")
def tr01_trace(spark, sf):
    nodes = warehouse(spark, sf)
    first = nodes.where("NOT is_directory").agg(F.min("record_number")).head()[0]
    return tree.trace(nodes, "W", first)


@query(sql.w(f"SELECT {_IDS} FROM w WHERE parent_record_number = 101 AND record_number <> 101"))
def tr03_children(spark, sf):
    return tree.children(warehouse(spark, sf), "W", 101).select(*_ID)


@query(sql.dirs('SELECT CASE WHEN w.record_number = 5 THEN \'W:\\\' ELSE d.p || \'\\\' || w.name END AS "Path", w.name AS "Name", file_size AS "Size", allocated_size AS "Allocated", is_directory AS "IsDirectory", modification_time AS "Modified" FROM w JOIN d ON w.parent_record_number = d.record_number'))
def sk01_export(spark, sf):
    return sinks.csv_rows(_warehouse_with_parents(spark, sf))


@query(sql.dirs("SELECT '{\"path\":\"' || replace(CASE WHEN w.record_number = 5 THEN 'W:\\' ELSE d.p || '\\' || w.name END, '\\', '\\\\') || '\",\"size\":' || file_size || ',\"is_dir\":' || CASE WHEN is_directory THEN 'true' ELSE 'false' END || '}' AS value FROM w JOIN d ON w.parent_record_number = d.record_number"))
def sk02_json(spark, sf):
    return sinks.json_rows(_warehouse_with_parents(spark, sf))


@query(sql.w(f", {_LOST}, s AS (SELECT CAST(count_if(NOT is_directory) AS BIGINT) AS files, CAST(count_if(is_directory) AS BIGINT) AS directories, CAST(sum(CASE WHEN is_directory THEN 0 ELSE file_size END) AS BIGINT) AS total_size FROM o) SELECT 'W' AS drive, files, directories, total_size, {sql.SIZE_TEXT.format('total_size')} AS total_size_text FROM s"))
def sk03_summary(spark, sf):
    return sinks.summary(tree.stats(_with_orphans(spark, sf))).select("drive", "files", "directories", "total_size", "total_size_text")


@query()
def tm01_treemap(spark, sf):
    return treemap.treemap(tree.rollup(*volumes.opened(spark, sf)))


@query(sql.w("SELECT record_number, total_size AS size, round(total_size / sum(total_size) OVER (), 6) AS area FROM (SELECT r.record_number, CAST(sum(f.file_size) AS BIGINT) AS total_size FROM w r JOIN w n ON n.parent_record_number = r.record_number JOIN w c ON c.parent_record_number = n.record_number JOIN w o ON o.parent_record_number = c.record_number JOIN w f ON f.parent_record_number = o.record_number WHERE r.parent_record_number = 5 AND r.record_number <> 5 GROUP BY 1)"))
def tm01_areas(spark, sf):
    """The outermost boxes: each has the share of the square that its size has of all."""
    boxes = treemap.treemap(tree.rollup(*volumes.opened(spark, sf))).where("depth = 0")
    return boxes.select("record_number", "size", F.round(F.col("w") * F.col("h"), 6).alias("area"))


@query(sql.dirs("SELECT string_agg(d.p, chr(10) ORDER BY d.p COLLATE C) AS paths FROM d WHERE d.depth = 2"))
def sk06_paths(spark, sf):
    return sinks.path_list(_warehouse_with_parents(spark, sf).where("depth = 2 AND is_directory"))


# --- volume images and journal pages: written from the driver's tables into the shared folder, and read again ------------------------------


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files_at(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _image(spark, sf, offset: int = 4096) -> str:
    """A volume whose records are the suppliers, in three extents of which one holds half a record more than whole ones."""
    rows = volumes.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey").collect()  # an image of some MB, made for this query
    cluster, size, keys = 512, 1024, {r.s_suppkey + 1: r for r in rows}
    last = max(keys, default=0)
    data = []
    for n in range(1, last + 1):
        r = keys.get(n)
        data.append(layouts.pack_record([layouts.pack_times(1, 2, 32), layouts.pack_name(r.s_nationkey + 100, r.s_name), layouts.pack_attribute(layouts.DATA, b"x" * (n % 50))], number=n) if r else bytes(size))
    clusters = 2 * (last + 1)
    a, b = clusters // 3, clusters // 2 + (clusters // 3 + clusters // 2 + 1) % 2
    runs = [(a, 40, False), (b - a, 40 + 3 * clusters, False), (clusters - b, 40 + clusters, False)]
    own = layouts.pack_record([layouts.pack_name(5, "table"), layouts.pack_attribute(layouts.DATA, runs=[r for r in runs if r[0]], size=clusters * cluster, allocated=clusters * cluster)])
    table = b"".join([own, *data])
    image = bytearray(offset + (40 + 5 * clusters) * cluster)
    image[offset : offset + 512] = layouts.pack_boot(cluster, 1, len(image) // cluster, 40, 2, -10)
    at = 0
    for n, lcn, _ in runs:
        image[offset + lcn * cluster : offset + (lcn + n) * cluster] = table[at : at + n * cluster]
        at += n * cluster
    path = _place(spark, "volume")
    files, place = _files_at(path)
    with files.open_output_stream(place) as f:
        f.write(bytes(image))
    return path


@query("SELECT s_suppkey + 1 AS record_number, CAST(s_nationkey AS BIGINT) + 100 AS parent_record_number, s_name AS name, (s_suppkey + 1) % 50 AS file_size FROM supplier UNION ALL SELECT 0, 5, 'table', CAST(1024 * (max(s_suppkey) + 2) AS BIGINT) FROM supplier")
def sc04_image(spark, sf):
    config = scan.ScanConfig("C", offset=4096)
    raw = scan.image_records(spark, _image(spark, sf), config, "volume", split=16)
    return scan.scan(raw, config).select(*_ID, "file_size")


@query("SELECT s_suppkey + 1 AS record_number, s_name AS name, true AS is_wanted FROM supplier WHERE s_suppkey + 1 IN (3, 7)")
def sc03_point_reads(spark, sf):
    raw = scan.image_records(spark, _image(spark, sf), scan.ScanConfig("C", offset=4096), "volume", [3, 7])
    return scan.checked(raw).join(scan.decode_records(raw).select("record_number", "name"), "record_number").select("record_number", "name", "is_wanted")


def _damaged(spark, sf):
    """Part records of which every fifth isn't in use and every seventh has lost its signature."""

    def pack(key: int, name: str) -> list[tuple]:
        return [("C", key, layouts.pack_record([layouts.pack_name(5, f"{name}-{key}")], in_use=key % 5 > 0, signature=layouts.FILE_SIGNATURE if key % 7 else 0x44414142))]

    return _packed(volumes.table(spark, sf, "part").select("p_partkey", "p_name"), pack)


@query("SELECT p_partkey AS record_number, p_name || '-' || p_partkey AS name FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def fl12_valid_records(spark, sf):
    return scan.scan(_damaged(spark, sf)).select("record_number", "name")


@query("SELECT p_partkey AS record_number, CASE WHEN p_partkey % 7 = 0 THEN 'bad signature' END AS error, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS is_valid FROM part")
def fl16_errors(spark, sf):
    return scan.decode_records(_damaged(spark, sf)).select("record_number", "error", "is_valid")


@query("SELECT p_partkey AS record_number, CAST(5 AS BIGINT) AS parent_record_number, p_name || '-' || p_partkey AS name FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def dc17_parent_info(spark, sf):
    return scan.parent_info(_damaged(spark, sf)).select(*_ID)


@query(f"WITH {_EXTENTS} SELECT p_partkey AS record_number, CASE WHEN p_partkey % 7 = 0 THEN '42414144' ELSE '46494C45' END AS signature, p_partkey // 4 AS vcn, EXISTS (SELECT 1 FROM e WHERE p_partkey // 4 >= e.vcn AND p_partkey // 4 < e.vcn + e.clusters) AS covered, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_name || '-' || p_partkey ELSE '' END AS name FROM part")
def tr02_inspect(spark, sf):
    e = extents.extent_map(_runs(spark, sf)).withColumn("drive", F.lit("C"))
    return scan.inspect(_damaged(spark, sf), e, 4096).select("record_number", "signature", "vcn", "covered", "name")


def _reported(rows: DataFrame, pack) -> DataFrame:
    """rows (drive, ...) through a function of the other columns that gives bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [pack(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["drive", "data"])

    return rows.mapInArrow(run, "drive string, data binary")


@query(f"WITH v AS (SELECT 'V' || s_suppkey AS drive, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey * 100000 * 4096 END AS t, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey * 1000 * 4096 END AS f, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey END AS n FROM supplier) SELECT drive, t AS total_bytes, f AS free_bytes, CASE WHEN t IS NULL THEN NULL ELSE {sql.SIZE_TEXT.format('t')} END AS total_text, CASE WHEN f IS NULL THEN NULL ELSE {sql.SIZE_TEXT.format('f')} END AS free_text, n AS estimated_records, n * 7 * 4096 AS mft_offset FROM v")
def sc19_volumes(spark, sf):
    def pack(key: int) -> bytes:
        return layouts.pack_volume(total_clusters=key * 100_000, free_clusters=key * 1000, bytes_per_sector=512, bytes_per_cluster=4096, bytes_per_record=1024, mft_bytes=key * 1024, mft_lcn=key * 7)[: 0x60 if key % 9 else 0x5F]

    rows = volumes.table(spark, sf, "supplier").select(F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("drive"), "s_suppkey")
    return scan.volumes(_reported(rows, pack)).select("drive", "total_bytes", "free_bytes", "total_text", "free_text", "estimated_records", "mft_offset")


@query("SELECT 'V' || s_suppkey AS drive, s_suppkey AS journal_id, s_suppkey * 2 AS first_usn, s_suppkey * 1000 AS next_usn FROM supplier")
def sc15_journals(spark, sf):
    rows = volumes.table(spark, sf, "supplier").select(F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("drive"), "s_suppkey")
    found = scan.journals(_reported(rows, lambda key: layouts.pack_journal(journal_id=key, first_usn=key * 2, next_usn=key * 1000)))
    return found.select("drive", "journal_id", "first_usn", "next_usn")


@query("SELECT 'C' AS drive, count(*) AS \"rows\", false AS failed FROM part UNION ALL SELECT 'D', (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) + (SELECT count(*) FROM orders), false UNION ALL SELECT 'X', 0, true")
def sc20_drives(spark, sf):
    rows = lambda: _packed(volumes.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), _extended_record)
    found, errors = scan.scan_drives({"C": lambda: _part_records(spark, sf), "D": rows, "X": lambda: scan.image_records(spark, f"{shared_folder(spark)}/no such image")})
    counts = merge.counted(found).select("drive", F.col("length").alias("rows"), F.lit(False).alias("failed"))
    return counts.unionByName(spark.createDataFrame([(d, 0, True) for d, e in errors.items() if e is not None], counts.schema))


@query("SELECT p_partkey AS record_number FROM part")
def sc10_fallback(spark, sf):
    found, errors = scan.scan_any({"journal": lambda: journal.pages(spark, f"{shared_folder(spark)}/no such journal"), "table": lambda: scan.scan(_part_records(spark, sf))})
    return found.select("record_number")


@query(sql.w(", o AS (SELECT * FROM w WHERE record_number NOT BETWEEN 1000 AND 1099) SELECT record_number, parent_record_number, name, false AS added FROM o UNION ALL SELECT 1000 + n_nationkey, CAST(100 + n_regionkey AS BIGINT), n_name, true FROM nation WHERE 1000 + n_nationkey IN (SELECT parent_record_number FROM o)"))
def sc17_parents(spark, sf):
    """The nations' directories are missing and come from elsewhere."""
    n = volumes.table(spark, sf, "nation")
    known = n.select(F.lit("W").alias("drive"), (F.col("n_nationkey") + 1000).cast("long").alias("record_number"), (F.col("n_regionkey") + 100).cast("long").alias("parent_record_number"), F.col("n_name").alias("name"))
    rows = merge.parent_overlay(warehouse(spark, sf).where("record_number NOT BETWEEN 1000 AND 1099"), known)
    return rows.select(*_ID, (F.col("source") == "overlay").alias("added"))


@query("SELECT c_name AS name, 'ext:' || lower(c_mktsegment) || ';x, y' AS search, c_mktsegment AS macro FROM customer WHERE c_custkey % 10 > 0")
def sc21_presets(spark, sf):
    name = F.when(F.col("c_custkey") % 10 > 0, F.col("c_name")).otherwise(F.lit(""))
    lines = volumes.table(spark, sf, "customer").select(F.concat(F.lit('"'), name, F.lit('",0,0,0,1,0,"ext:'), F.lower("c_mktsegment"), F.lit(';x, y","'), F.col("c_mktsegment"), F.lit('",')).alias("value"))
    path = _place(spark, "presets")
    lines.unionByName(spark.createDataFrame([("Name,Case,Whole Word,Path,Diacritics,Regex,Search,Macro,Key",), ('"short",0',), ("",)], "value string")).write.text(path)
    return scan.read_presets(spark, path)


@query("SELECT c_custkey, [c_name, 'x, y', CAST(c_custkey AS VARCHAR), ''] AS fields FROM customer")
def fn07_csv_fields(spark, sf):
    rows = volumes.table(spark, sf, "customer")
    line = F.concat(F.lit('"'), F.col("c_name"), F.lit('","x, y",'), F.col("c_custkey").cast("string"), F.lit(","))
    return rows.select("c_custkey", fn.csv_fields(line).alias("fields"))


@query("WITH t AS (SELECT p_partkey, p_partkey % 360 AS h FROM part), c AS (SELECT *, 0.342 * (1 - abs((h / 60.0 - 2 * floor(h / 120.0)) - 1)) AS x, h // 60 AS s FROM t) SELECT p_partkey, concat_ws(',', CAST(floor((CASE WHEN s IN (0, 5) THEN 0.342 WHEN s IN (1, 4) THEN x ELSE 0 END + 0.209) * 255) AS INTEGER), CAST(floor((CASE WHEN s IN (1, 2) THEN 0.342 WHEN s IN (0, 3) THEN x ELSE 0 END + 0.209) * 255) AS INTEGER), CAST(floor((CASE WHEN s IN (3, 4) THEN 0.342 WHEN s IN (2, 5) THEN x ELSE 0 END + 0.209) * 255) AS INTEGER)) AS rgb, ['0,190,230', '90,200,70', '230,190,40', '210,90,200', '70,140,240', '230,130,50', '130,210,180'][p_partkey % 7 + 1] AS border, ['8,22,28', '12,24,10', '26,22,8', '24,12,24', '10,16,30', '26,16,8', '12,24,20'][p_partkey % 7 + 1] AS background FROM c")
def fn15_colours(spark, sf):
    k = F.col("p_partkey")
    return volumes.table(spark, sf, "part").select(k, fn.hsl_to_rgb(k % 360, 0.45, 0.38).alias("rgb"), tables.depth_colour(k).alias("border"), tables.depth_colour(k, tables.DEPTH_BACKGROUNDS).alias("background"))


@query("SELECT s_suppkey, ['None', 'After', 'Before', 'Between'][(s_suppkey + 1) % 4 + 1] AS next_date, ['None', '>', '<', 'Between'][(s_suppkey + 3) % 4 + 1] AS previous_size, ['Initializing', 'USN Enumeration', 'MFT Reading', 'Building Tree', 'Calculating Sizes', 'Complete'][s_suppkey % 6 + 1] AS phase, ['Name', 'Path', 'Size', 'Ext', 'Date Modified', 'Type'][s_suppkey % 6 + 1] AS sort_label FROM supplier")
def fn25_labels(spark, sf):
    k = F.col("s_suppkey")
    mode = lambda table, at: F.element_at(F.create_map(*[F.lit(x) for m in table for x in (m, tables.cycled(table, m, at))]), F.element_at(F.array(*map(F.lit, table)), (k % 4 + 1).cast("int")))
    pick = lambda labels: F.element_at(F.array(*map(F.lit, labels)), (k % len(labels) + 1).cast("int"))
    return volumes.table(spark, sf, "supplier").select(k, mode(tables.DATE_MODES, 1).alias("next_date"), mode(tables.SIZE_MODES, -1).alias("previous_size"), pick(tables.PHASES).alias("phase"), pick(list(tables.SORT_LABELS.values())).alias("sort_label"))


@query(f"WITH {sql.JOURNAL} SELECT record_number, parent_record_number, name, attributes & 16 <> 0 AS is_directory, CAST(0 AS BIGINT) AS file_size, 'usn' AS source FROM j")
def pj05_journal_nodes(spark, sf):
    rows = volumes.journal(spark, sf).withColumn("file_reference_number", F.col("record_number"))
    return scan.nodes_from_journal(rows).select(*_ID, "is_directory", "file_size", "source")


@query(sql.w(f"SELECT CAST(count(*) AS BIGINT) AS objects, CAST(greatest(count_if(file_size > 10224640), 1) AS BIGINT) AS selected, ' ' || count(*) || ' objects | ' || greatest(count_if(file_size > 10224640), 1) || ' selected | ' || {sql.SIZE_TEXT.format('CAST(sum(file_size) AS BIGINT)')} || ' total' AS label FROM w WHERE NOT is_directory"))
def ag05_selection(spark, sf):
    files = warehouse(spark, sf).where("NOT is_directory")
    return merge.selection(files, files.where("file_size > 10224640")).select("objects", "selected", "label")


@query(f"WITH {sql.JOURNAL} SELECT drive, CAST(count(*) AS BIGINT) AS changes, CAST(count(DISTINCT record_number) AS BIGINT) AS records, min(usn) AS first_usn, max(usn) AS last_usn FROM c WHERE reason IN ('Modified', 'AttributeChange') GROUP BY drive")
def ag07_changes(spark, sf):
    return merge.changes_by_drive(journal.changes(volumes.journal(spark, sf)).where("reason IN ('Modified', 'AttributeChange')"))


@query(sql.w("SELECT 'W' AS drive, CAST(count(*) AS BIGINT) AS length FROM w"))
def ag11_length(spark, sf):
    return merge.counted(warehouse(spark, sf))


def _written_pages(spark, sf, per_page: int = 500) -> str:
    """The journal as files of pages, named by their first usn."""
    folder = _place(spark, "journal")
    files, place = _files_at(folder)
    files.create_dir(place)

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("usn")
        first, last = int(part["usn"].iloc[0]), int(part["usn"].iloc[-1])
        records = [layouts.pack_usn(r.record_number, r.parent_record_number, r.file_name, r.usn, r.timestamp, r.reason_bits, r.attributes) for r in part.rename(columns={"name": "file_name"}).itertuples()]
        files, at = _files_at(folder)
        with files.open_output_stream(f"{at}/{first:020d}.bin") as f:
            f.write(struct.pack("<Q", last + 1) + b"".join(records))
        return pd.DataFrame({"first": [first]})

    pages = volumes.journal(spark, sf).groupBy(F.floor(F.col("usn") / per_page).alias("page")).applyInPandas(write, "first long")
    pages.count()
    return folder


@query(f"WITH {sql.JOURNAL} SELECT usn, record_number, name, reason_bits, \"timestamp\" FROM j WHERE usn >= 777 AND reason_bits & {journal.MASK} <> 0")
def sr01_pages(spark, sf):
    return journal.pages(spark, _written_pages(spark, sf), "E", 777).select("usn", "record_number", "name", "reason_bits", "timestamp")
