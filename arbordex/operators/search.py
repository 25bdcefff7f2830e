"""Search: a query and its filters compiled to one predicate, sorting and top-k.

Catalyst orders and pushes the conjuncts; nothing here runs row by row in Python.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import extension, format_filetime, format_size, has_attribute, parse_date, parse_scope, parse_size
from ..functions.tables import type_label
from ..schema import ATTRIBUTES


@dataclass(frozen=True)
class SearchSpec:
    """What a user asks for. Sizes and dates are texts, as typed: what can't be parsed is ignored, or raises with on_error='raise'."""

    query: str = ""
    regex: str = ""
    extensions: str = ""
    date_mode: str = "None"
    date_start: str = ""
    date_end: str = ""
    size_mode: str = "None"
    size_start: str = ""
    size_end: str = ""
    directories_only: bool = False
    boundary: bool = False  # a scope ends at a separator
    on_error: str = "ignore"


def _unusable(spec: SearchSpec, what: str) -> None:
    if spec.on_error == "raise":
        raise ValueError(what)
    warnings.warn(f"{what}: ignored", stacklevel=3)


def wildcard(name: Column, pattern: str) -> Column:
    """FL03: a star at either end is a wildcard, anything else literal. name and pattern are lower-cased."""
    if not pattern.strip("*") and len(pattern) <= 2:
        return F.lit(True)
    lead, trail = pattern.startswith("*"), pattern.endswith("*")
    text = pattern[lead : len(pattern) - trail]
    if lead == trail:
        return name.contains(F.lit(text))
    return F.endswith(name, F.lit(text)) if lead else F.startswith(name, F.lit(text))


def any_pattern(name: Column, text: str) -> Column:
    """FL04: patterns between semicolons, any of which may match; none at all match nothing."""
    patterns = [p for p in (p.strip() for p in text.split(";")) if p]
    return reduce(lambda a, b: a | b, (wildcard(name, p) for p in patterns), F.lit(False))


def in_scope(path_lower: Column, scope: str, boundary: bool = False) -> Column:
    """FL05"""
    scope = scope.lower()
    fits = F.startswith(path_lower, F.lit(scope))
    if boundary:
        fits = fits & ((path_lower == scope) | F.startswith(path_lower, F.lit(scope.rstrip("\\") + "\\")))
    return (path_lower != "") & fits


_POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "space": r"\s", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "punct": r"\p{Punct}"}


def java_regex(pattern: str) -> str | None:
    """FL06: the pattern in Java's dialect, with Unicode classes; None if it is no valid pattern or can't be said."""
    if re.search(r"\(\?(=|!|<=|<!|>)|\\[1-9]|\\k<", pattern):
        return None
    out = re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + m[1].replace("_", "") + ">", pattern)
    out = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), out)
    out = re.sub(r"(\\.|\[(?:\\.|[^\]\\])*\])|\$$", lambda m: m[1] or r"\\z".replace("\\\\", "\\"), out)
    try:
        re.compile(re.sub(r"\\p\{\w+\}|\\z|\(\?<(?![=!])\w+>", lambda m: "(" if m[0][0] == "(" else "x", out))
    except re.error:
        return None
    return "(?U)" + out


def date_filter(time: Column, spec: SearchSpec) -> Column | None:
    """FL07: bounds are inclusive; an unknown (0) time never matches. Before looks at the start field."""
    start, end = parse_date(spec.date_start), parse_date(spec.date_end)
    known = time != 0
    if spec.date_mode == "After" and start is not None:
        return known & (time >= start)
    if spec.date_mode == "Before" and start is not None:
        return known & (time <= start)
    if spec.date_mode == "Between" and start is not None and end is not None:
        return known & time.between(start, end)
    if spec.date_mode != "None":
        _unusable(spec, f"date {spec.date_start!r} {spec.date_end!r}")
    return None


def size_filter(size: Column, spec: SearchSpec) -> Column | None:
    """FL08"""
    start, end = parse_size(spec.size_start), parse_size(spec.size_end)
    if spec.size_mode == ">" and start is not None:
        return size > start
    if spec.size_mode == "<" and start is not None:
        return size < start
    if spec.size_mode == "Between" and start is not None and end is not None:
        return size.between(start, end)
    if spec.size_mode != "None":
        _unusable(spec, f"size {spec.size_start!r} {spec.size_end!r}")
    return None


def extension_filter(ext: Column, extensions: str) -> Column | None:
    """FL09"""
    wanted = [e for e in (e.strip().lower() for e in extensions.split(";")) if e]
    return ext.isin(wanted) if wanted else None


def predicate(spec: SearchSpec) -> Column:
    """FL10: all of scope, text, regex, date, size and extension. Over rows of projected()."""
    if spec.directories_only:
        return F.col("is_directory")
    scope, text = parse_scope(spec.query.strip().lower())
    parts: list[Column | None] = []
    if scope is not None:
        parts.append(in_scope(F.col("path_lower"), scope, spec.boundary))
    if text:
        parts.append(any_pattern(F.col("name_lower"), text))
    if spec.regex:
        if (pattern := java_regex(spec.regex)) is None:
            _unusable(spec, f"regex {spec.regex!r}")
        else:
            parts.append(F.col("name").rlike(pattern))
    parts += [date_filter(F.col("modification_time"), spec), size_filter(F.col("file_size"), spec), extension_filter(F.col("extension"), spec.extensions)]
    return reduce(lambda a, b: a & b, (p for p in parts if p is not None), F.lit(True))


def preset(search: str, base: SearchSpec | None = None) -> SearchSpec:
    """FL13, FL14: what choosing a saved filter makes of a search."""
    base = base or SearchSpec()
    if search == "":
        return SearchSpec()
    if search.startswith("folder:"):
        return SearchSpec(directories_only=True)
    if search.startswith("ext:"):
        return SearchSpec(**{**base.__dict__, "extensions": search[4:]})
    return base


def projected(nodes: DataFrame) -> DataFrame:
    """PJ02: rows with a name, with name_lower, extension and, if there is a parent_path, path_lower."""
    rows = nodes.where("name <> ''").withColumns({"name_lower": F.lower("name"), "extension": extension(F.col("name"))})
    return rows.withColumn("path_lower", F.lower("parent_path") if "parent_path" in nodes.columns else F.lit(""))


def search(nodes: DataFrame, spec: SearchSpec) -> DataFrame:
    return projected(nodes).where(predicate(spec))


def substring_search(nodes: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """FL01, FL17: names that contain the pattern, whatever its case; in a fixed order, where any order will do."""
    hits = nodes.where(F.col("name") != "").where(F.lower("name").contains(F.lit(pattern.lower())))
    return hits.orderBy("drive", "record_number", "parent_record_number", "name").limit(most)


def glob_search(nodes: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """FL02: stars and question marks are left out."""
    return substring_search(nodes, re.sub(r"[*?]", "", pattern), most)


def visible(nodes: DataFrame, hidden: bool = False, system: bool = False) -> DataFrame:
    """FL11, SC09: without rows that are hidden or the system's, unless they are asked for."""
    for keep, name in ((hidden, "hidden"), (system, "system")):
        if not keep:
            nodes = nodes.where(~has_attribute(F.col("attributes"), ATTRIBUTES[name]))
    return nodes


#: SO01: what a column sorts by. Directories sort by their own size, which is 0.
SORT_KEYS = {
    "name": lambda: [F.lower("name")],
    "path": lambda: [F.concat_ws("\\", F.rtrim(F.lower("parent_path"), F.lit("\\")), F.lower("name"))],
    "size": lambda: [F.col("file_size")],
    "extension": lambda: [extension(F.col("name"))],
    "modified": lambda: [F.col("modification_time")],
    "type": lambda: [type_label(F.col("is_directory"), extension(F.col("name")))],
}
TIES = ["drive", "record_number", "parent_record_number", "name"]


def sort_by(nodes: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """SO01, SO02: ties are always in the order of TIES, in either direction."""
    keys = SORT_KEYS[column]()
    return nodes.orderBy(*[k.desc() if descending else k.asc() for k in keys], *TIES)


def page(rows: DataFrame, offset: int, count: int) -> DataFrame:
    """TK05: a window of sorted rows."""
    return rows.offset(offset).limit(count)


def largest_files(nodes: DataFrame, count: int = 20) -> DataFrame:
    """TK01"""
    return nodes.where("NOT is_directory AND name <> ''").orderBy(F.desc("file_size"), *TIES).limit(count)


def display(nodes: DataFrame) -> DataFrame:
    """PJ03: texts as they are shown."""
    ext = extension(F.col("name"))
    return nodes.withColumns({
        "size_text": F.when(F.col("is_directory") | (F.col("file_size") == 0), "").otherwise(format_size(F.col("file_size"))),
        "date_text": F.when(F.col("modification_time") == 0, "").otherwise(format_filetime(F.col("modification_time"))),
        "type_label": type_label(F.col("is_directory"), ext),
    })
