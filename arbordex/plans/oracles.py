"""DuckDB SQL for the registered queries. It shares the projections of the driver's tables with them, never an operator."""

from __future__ import annotations

EPOCH = 116444736000000000


def _node(record: str, parent: str, name: str, size: str = "0", attributes: str = "16", directory: str = "true", created: str = "0", modified: str = "0", drive: str = "W") -> str:
    return f"""SELECT '{drive}' AS drive, CAST({record} AS BIGINT) AS record_number, CAST({parent} AS BIGINT) AS parent_record_number, CAST({record} AS BIGINT) AS file_reference_number, {name} AS name,
      CAST({size} AS BIGINT) AS file_size, CAST(ceil(({size}) / 4096.0) * 4096 AS BIGINT) AS allocated_size, CAST({attributes} AS BIGINT) AS attributes, {directory} AS is_directory,
      CAST({created} AS BIGINT) AS creation_time, CAST({modified} AS BIGINT) AS modification_time"""


def _ticks(c: str) -> str:
    return f"epoch_us({c}) * 10 + {EPOCH}"


W_RAW = "w_raw AS (" + " UNION ALL ".join([
    _node("5", "5", "'.'"),
    _node("100 + r_regionkey", "5", "r_name") + " FROM region",
    _node("1000 + n_nationkey", "100 + n_regionkey", "n_name") + " FROM nation",
    _node("1000000 + c_custkey", "1000 + c_nationkey", "c_name") + " FROM customer",
    _node("100000000 + o_orderkey", "1000000 + o_custkey", "'order-' || o_orderkey", created=_ticks("o_orderdate"), modified=_ticks("o_orderdate")) + " FROM orders",
    _node("(l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey + 10000000000", "100000000 + l_orderkey", "'Line' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '.log' WHEN 'N' THEN '.tar.gz' ELSE '.TXT' END",
          "round(l_extendedprice * 100)", "32 + CASE WHEN l_suppkey % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 11 = 0 THEN 4 ELSE 0 END", "false", _ticks("l_shipdate"), _ticks("l_shipdate")) + " FROM lineitem",
]) + ")"
#: ST02 over it.
W = W_RAW + """, w AS MATERIALIZED (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY parent_record_number, lower(name) ORDER BY record_number, name, file_size, allocated_size, attributes, creation_time, modification_time) AS n FROM w_raw) WHERE n = 1)"""
#: Directory paths by recursion.
DIRS = """, d AS (SELECT record_number, parent_record_number, 'W:' AS p, 0 AS depth, [record_number] AS line FROM w WHERE record_number = 5
  UNION ALL SELECT c.record_number, c.parent_record_number, d.p || '\\' || c.name, d.depth + 1, list_append(d.line, c.record_number) FROM w c JOIN d ON c.parent_record_number = d.record_number WHERE c.is_directory AND c.record_number <> 5)"""
#: Totals: each node counts for itself and for all directories above it.
TOTALS = """, sums AS (SELECT u.anc AS record_number, CAST(sum(w.file_size) AS BIGINT) AS total_size, CAST(sum(w.allocated_size) AS BIGINT) AS total_allocated, CAST(count_if(NOT w.is_directory) AS BIGINT) AS file_count, CAST(count_if(w.is_directory) AS BIGINT) AS dir_count
  FROM (SELECT record_number, unnest(line) AS anc FROM d) u JOIN w ON (w.parent_record_number = u.record_number AND w.record_number <> 5) GROUP BY 1),
rolled AS (SELECT w.*, w.file_size + CASE WHEN is_directory THEN coalesce(s.total_size, 0) ELSE 0 END AS total_size, w.allocated_size + CASE WHEN is_directory THEN coalesce(s.total_allocated, 0) ELSE 0 END AS total_allocated,
  CASE WHEN is_directory THEN coalesce(s.file_count, 0) ELSE 1 END AS file_count, CASE WHEN is_directory THEN 1 + coalesce(s.dir_count, 0) ELSE 0 END AS dir_count FROM w LEFT JOIN sums s USING (record_number))"""


def w(select: str) -> str:
    return f"WITH {W} {select}"


def dirs(select: str) -> str:
    return f"WITH RECURSIVE {W} {DIRS} {select}"


def rolled(select: str) -> str:
    return f"WITH RECURSIVE {W} {DIRS} {TOTALS} {select}"


SIZE_TEXT = "CASE " + "".join(f"WHEN {{0}} >= {1024**i} THEN printf('%.2f', {{0}} / {1024**i}.0) || ' {u}' " for i, u in [(5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")]) + "ELSE {0} || ' B' END"
UNIX = f"CASE WHEN {{0}} < {EPOCH} THEN 0 ELSE ({{0}} - {EPOCH}) // 10000000 END"
EXT = "lower(regexp_extract({0}, '(?s)^.+[.]([^.]+)$', 1))"
PAGES = r"""p AS (SELECT page_id, 'P:\' || replace(regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^(.*)/[^/]*$', 1), '/', '\') AS parent_path, regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '/([^/]*)$', 1) AS name FROM pages)"""
JOURNAL = f"""j AS (SELECT 'E' AS drive, user_id AS record_number, CAST(user_id % 10 + 100 AS BIGINT) AS parent_record_number, 'u' || user_id || '-' || event_id AS name,
  CAST(CASE event_type WHEN 'signup' THEN 256 WHEN 'error' THEN 512 WHEN 'click' THEN 1 WHEN 'view' THEN 1024 WHEN 'purchase' THEN 32770 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 2147483648 ELSE 0 END AS BIGINT) AS reason_bits,
  CAST(32 AS BIGINT) AS attributes, event_id AS usn, {_ticks("ts")} AS "timestamp" FROM events),
r AS (SELECT *, CASE WHEN reason_bits & 256 <> 0 THEN 'Created' WHEN reason_bits & 512 <> 0 THEN 'Deleted' WHEN reason_bits & 4096 <> 0 THEN 'RenamedFrom' WHEN reason_bits & 8192 <> 0 THEN 'RenamedTo'
  WHEN reason_bits & 2048 <> 0 THEN 'SecurityChange' WHEN reason_bits & 32768 <> 0 THEN 'AttributeChange' WHEN reason_bits & 7 <> 0 THEN 'Modified' ELSE 'Other' END AS reason FROM j),
c AS (SELECT * FROM r WHERE reason_bits & 2147483648 <> 0 OR reason <> 'Other')"""
LINKS = f"""h AS ({_node("l_partkey", "l_orderkey + 100000000", "'part' || l_partkey || '.dll'", "round(p_retailprice * 100)", "32", "false", drive="H")} FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN part ON l_partkey = p_partkey)"""
