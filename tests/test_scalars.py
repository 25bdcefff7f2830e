from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbordex.functions import scalars as fn
from arbordex.functions import tables
from arbordex.operators.search import SearchSpec, java_regex, predicate, preset
from arbordex.schema import EPOCH


def values(spark, kind, inputs, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_format_size(spark):
    sizes = [0, 1, 1023, 1024, 1152, 1536, 1048576, 1024**5, 1024**6]
    assert values(spark, "long", sizes, fn.format_size) == ["0 B", "1 B", "1023 B", "1.00 KB", "1.12 KB", "1.50 KB", "1.00 MB", "1.00 PB", "1024.00 PB"]


def test_filetime(spark):
    assert values(spark, "long", [0, EPOCH, EPOCH + 19_999_999], fn.filetime_to_unix) == [0, 0, 1]
    assert values(spark, "long", [0, EPOCH, EPOCH + 86400 * 10**7], fn.format_filetime) == ["1970-01-01 00:00:00", "1970-01-01 00:00:00", "1970-01-02 00:00:00"]


SIZES = {"10MB": 10485760, "1.5 KB": 1536, "100": 100, "10K": None, "-5MB": 0, "1.5": None, "": None, " 7 b ": 7}
DATES = {"1970-01-01": EPOCH, "2025-02-30": None, "2025-1-1": 133801632000000000, "2025/01/01": None, "x": None, "1601-01-01": 0, "1500-01-01": None}


@pytest.mark.parametrize("text", SIZES)
def test_parse_size(text):
    assert fn.parse_size(text) == SIZES[text]


def test_parse_columns(spark):
    assert values(spark, "string", list(SIZES), fn.parse_size_column) == list(SIZES.values())
    known = {k: v for k, v in DATES.items() if k != "1500-01-01"}
    assert values(spark, "string", list(known), fn.parse_date_column) == list(known.values())


@pytest.mark.parametrize("text", DATES)
def test_parse_date(text):
    assert fn.parse_date(text) == DATES[text]


def test_names(spark):
    names = ["b.tar.gz", ".bashrc", "a.", "README", "X.TXT", "a\nb.c"]
    assert values(spark, "string", names, fn.extension) == ["gz", "", "", "", "txt", "c"]
    assert values(spark, "string", names[:5], fn.last_part) == ["gz", "bashrc", "", "readme", "txt"]
    assert values(spark, "string", ["foo", ""], fn.extension_hue) == [54, 0]
    assert values(spark, "string", ["X:\\a\\b", "X:\\a", "X:\\"], fn.parent_dir) == ["X:\\a", "X:\\", "X:\\"]
    assert values(spark, "string", ["a.foo", "b.pdf"], lambda c: fn.leaf_colour(c, F.lit(False), F.lit(0))) == ["140,131,53", "200,50,50"]
    assert values(spark, "string", ["exe", "zzz"], lambda c: tables.type_label(F.lit(False), c)) == ["Application", "File"]
    assert values(spark, "string", ["ab"], lambda c: fn.fit_title(c, F.lit(5), 20)) == [" ab (5 B) "]


def test_references(spark):
    high = fn.reference_of(F.lit(7), F.lit(0x9000))
    assert spark.range(1).select(fn.record_of(high), high < 0).head() == (7, True)
    bits = [0x100, 0x300, 0x3000, 0x2000, 0x8800, 0x8000, 0x4, 0x80000000, 0]
    assert values(spark, "long", bits, fn.classify_reason) == ["Created", "Created", "RenamedFrom", "RenamedTo", "SecurityChange", "AttributeChange", "Modified", "Other", "Other"]
    assert values(spark, "int", [-10, 1, 2], lambda c: fn.bytes_per_record(c, F.lit(4096))) == [1024, 4096, 8192]


def test_query_texts():
    assert fn.parse_scope("`c:\\foo` x") == ("c:\\foo", "x")
    assert fn.parse_scope("a `c:` b") == ("c:", "a b")
    assert fn.parse_scope("a `` b") == (None, "a `` b")
    assert fn.parse_scope("a ` b") == (None, "a ` b")
    assert fn.parse_csv_fields('"A,B",0,"ext:x;y",,') == ["A,B", "0", "ext:x;y", "", ""]
    assert tables.cycled(tables.DATE_MODES, "Between") == "None" and tables.cycled(tables.SIZE_MODES, "None", -1) == "Between"


def test_regex_dialect(spark):
    assert java_regex("(") is None and java_regex("(?=x)") is None
    names = spark.createDataFrame([("é",), ("a1\n",), ("b_2",)], "name string")
    found = lambda p: {r[0] for r in names.where(F.col("name").rlike(java_regex(p))).collect()}
    assert found(r"^\w$") == {"é"}
    assert found("1$") == set()
    assert found("(?P<n>[[:alpha:]])_") == {"b_2"}


def test_search_filters(spark):
    rows = [("a.TXT", 10, 0, False), ("b.log", 0, EPOCH, False), ("dir", 0, EPOCH + 1, True), ("c_d", 5, EPOCH + 864000000000, False)]
    nodes = spark.createDataFrame(rows, "name string, file_size long, modification_time long, is_directory boolean").withColumns({"name_lower": F.lower("name"), "extension": fn.extension(F.col("name")), "path_lower": F.lit("c:\\foobar")})
    hits = lambda **k: {r["name"] for r in nodes.where(predicate(SearchSpec(**k))).collect()}
    assert hits() == {"a.TXT", "b.log", "dir", "c_d"} == hits(query="**") == hits(query="")
    assert hits(query=";") == set()
    assert hits(query="*.txt; c_*") == {"a.TXT", "c_d"}
    assert hits(query="a?t") == set() == hits(query="a*t")
    assert hits(query="`c:\\foo` b") == {"b.log"} and hits(query="`c:\\foo` b", boundary=True) == set()
    assert hits(size_mode="<", size_start="1") == {"b.log", "dir"}
    assert hits(size_mode=">", size_start="10K") == hits()
    assert hits(date_mode="Between", date_start="1970-01-01", date_end="1970-01-02") == {"b.log", "dir", "c_d"}
    assert hits(date_mode="Before", date_start="1970-01-01") == {"b.log"}
    assert hits(regex="(") == hits()
    with pytest.raises(ValueError):
        hits(regex="(", on_error="raise")
    assert preset("folder:").directories_only and preset("ext:a;b").extensions == "a;b" and preset("x:y") == SearchSpec()
