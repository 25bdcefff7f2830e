"""Scalar functions as columns, and the parsers that run when a query is compiled."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPOCH, REASONS, RECORD_MASK, TICKS
from .tables import folder_fill, known_leaf_colour

UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def format_size(size: Column) -> Column:
    """FN01: '0 B', '1023 B', '1.50 KB'; ties round to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS[1:], 1):
        scaled = F.format_string("%.2f", F.bround(size / F.lit(float(1024**i)), 2))
        out = F.when(size >= 1024**i, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def filetime_to_unix(ticks: Column) -> Column:
    """FN03: whole seconds since 1970; earlier times are 0."""
    return F.when(ticks < EPOCH, F.lit(0)).otherwise(((ticks - EPOCH) - F.pmod(ticks - EPOCH, F.lit(TICKS))) / TICKS).cast("long")


def format_filetime(ticks: Column) -> Column:
    """FN02: UTC, whatever the session's time zone is."""
    return F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=filetime_to_unix(ticks).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")


def unix_to_filetime(micros: Column) -> Column:
    return micros * 10 + EPOCH


def extension(name: Column) -> Column:
    """FN08: what follows the last dot, lower-cased, unless the dot is first or last."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def last_part(name: Column) -> Column:
    """FN09: what follows the last dot, or the whole name, lower-cased."""
    return F.lower(F.substring_index(name, ".", -1))


def extension_hash(ext: Column) -> Column:
    """The unsigned 32-bit sum a * 31 + byte over the UTF-8 bytes."""
    digits = F.hex(F.encode(ext, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, i: (a * 31 + F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))


def extension_hue(ext: Column) -> Column:
    """FN14"""
    return F.pmod(extension_hash(ext), F.lit(360)).cast("int")


def hsl_to_rgb(hue: Column, saturation: float, lightness: float) -> Column:
    """FN15: 'r,g,b', cut off to whole numbers."""
    chroma = (1 - abs(2 * lightness - 1)) * saturation
    x = chroma * (1 - F.abs((hue / 60) % 2 - 1))
    low = lightness - chroma / 2
    full, none = F.lit(chroma), F.lit(0.0)
    sixths = [(full, x, none), (x, full, none), (none, full, x), (none, x, full), (x, none, full), (full, none, x)]
    sixth = F.floor(hue / 60)
    part = lambda i: F.floor((F.coalesce(*[F.when(sixth == k, s[i]) for k, s in enumerate(sixths)], sixths[-1][i]) + low) * 255).cast("int")
    return F.concat_ws(",", part(0), part(1), part(2))


def leaf_colour(name: Column, is_directory: Column, index: Column) -> Column:
    """FN13"""
    ext = last_part(name)
    return F.when(is_directory, folder_fill(index)).otherwise(F.coalesce(known_leaf_colour(ext), hsl_to_rgb(extension_hue(ext), 0.45, 0.38)))


def record_of(reference: Column) -> Column:
    """FN17: the record number in a file reference."""
    return reference.bitwiseAND(F.lit(RECORD_MASK))


def reference_of(record: Column, sequence: Column) -> Column:
    """FN17: record and sequence as one (signed) number."""
    return record.bitwiseOR(F.shiftleft(sequence.cast("long"), 48))


def has_attribute(attributes: Column, bit: int) -> Column:
    """FN18, FL15"""
    return attributes.bitwiseAND(F.lit(bit)) != 0


# Which reason bits name a change, in order of priority.
REASON_NAMES = [
    ("Created", ["file_create"]), ("Deleted", ["file_delete"]), ("RenamedFrom", ["rename_old_name"]), ("RenamedTo", ["rename_new_name"]),
    ("SecurityChange", ["security_change"]), ("AttributeChange", ["basic_info_change"]), ("Modified", ["data_overwrite", "data_extend", "data_truncation"]),
]


def classify_reason(bits: Column) -> Column:
    """FN19"""
    return F.coalesce(*[F.when(bits.bitwiseAND(F.lit(sum(REASONS[n] for n in names))) != 0, label) for label, names in REASON_NAMES], F.lit("Other"))


def parent_dir(path: Column) -> Column:
    """FN20: the path without its last part; a drive's root is its own parent."""
    cut = F.regexp_replace(path, r"\\[^\\]*$", "")
    return F.when(cut.rlike(r"^[^\\]*:$"), F.concat(cut, F.lit("\\"))).otherwise(cut)


def bytes_per_record(clusters: Column, bytes_per_cluster: Column) -> Column:
    """FN24: negative counts are powers of two."""
    return F.when(clusters < 0, F.call_function("shiftleft", F.lit(1).cast("long"), -clusters)).otherwise(clusters * bytes_per_cluster).cast("long")


def shortened(text: Column, width: int) -> Column:
    """FN21: at most width characters, the last of them an ellipsis if some are cut."""
    return F.when(F.length(text) <= width, text).otherwise(F.left(text, F.lit(width)) if width <= 1 else F.concat(F.left(text, F.lit(width - 1)), F.lit("…")))


def padded(text: Column, width: int) -> Column:
    """FN21: exactly width characters."""
    return F.rpad(text, width, " ")


def fit_title(name: Column, size: Column, width: int) -> Column:
    """FN21: ' name (size) ', ' name ' or a cut name, whichever fits; lengths count UTF-8 bytes."""
    if width < 6:
        return F.lit("")
    full, short = F.concat(F.lit(" "), name, F.lit(" ("), format_size(size), F.lit(") ")), F.concat(F.lit(" "), name, F.lit(" "))
    room = width - 4
    cut = F.concat(F.lit(" "), F.left(name, F.lit(room - 2)), F.lit("… ")) if room > 2 else F.lit("")
    return F.when(F.octet_length(full) <= room + 2, full).when(F.octet_length(short) <= room + 2, short).otherwise(cut)


def parse_size(text: str) -> int | None:
    """FN04: '10MB', '1.5 KB' or a whole number of bytes; None if it is neither. Negative sizes count as 0."""
    text = text.strip().upper()
    for unit, scale in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1), ("B", 0)):
        if text.endswith(unit):
            number = text[: -len(unit)].strip()
            if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(E[+-]?\d+)?", number):
                return None
            return max(0, min(int(float(number) * 1024**scale), (1 << 64) - 1))
    return int(text) if re.fullmatch(r"\+?\d+", text) else None


def parse_size_column(text: Column) -> Column:
    """FN04 as a column; null where parse_size gives None."""
    upper = F.upper(F.trim(text))
    number = F.regexp_extract(upper, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*(?:TB|GB|MB|KB|B)$", 1)
    unit = F.regexp_extract(upper, r"(TB|GB|MB|KB|B)$", 1)
    scale = F.coalesce(*[F.when(unit == u, F.lit(float(1024**i))) for i, u in enumerate(UNITS[:5])])
    whole = F.regexp_extract(upper, r"^\+?([0-9]+)$", 1)
    return F.when(number != "", F.greatest(F.lit(0), F.floor(number.cast("double") * scale))).when(whole != "", whole.try_cast("long")).cast("long")


def parse_date(text: str) -> int | None:
    """FN05: 'year-month-day' as ticks of its start in UTC; None if it isn't a date from 1601 on."""
    parts = text.strip().split("-")
    if len(parts) != 3 or not all(re.fullmatch(r"\d+", p) for p in parts):
        return None
    try:
        days = datetime.date(*map(int, parts)).toordinal() - datetime.date(1970, 1, 1).toordinal()
    except (ValueError, OverflowError):
        return None
    return ticks if (ticks := days * 86400 * TICKS + EPOCH) >= 0 else None


def parse_date_column(text: Column) -> Column:
    """FN05 as a column."""
    parts = [F.regexp_extract(F.trim(text), r"^([0-9]+)-([0-9]+)-([0-9]+)$", i).try_cast("int") for i in (1, 2, 3)]
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", *parts), "yyyy-MM-dd")
    return F.when(parts[0].isNotNull(), F.unix_date(day).cast("long") * (86400 * TICKS) + EPOCH)


def parse_scope(query: str) -> tuple[str | None, str]:
    """FN06: the path between two backticks, and the rest of the query."""
    before, tick, rest = query.partition("`")
    scope, tick2, after = rest.partition("`")
    if not (tick and tick2 and scope.strip()):
        return None, query
    return scope.strip(), " ".join(p for p in (before.strip(), after.strip()) if p)


def parse_csv_fields(line: str) -> list[str]:
    """FN07: commas outside quotes separate; quotes around a field go; doubled quotes have no meaning."""
    return [f.strip('"') for f in re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*$)', line)]


def csv_fields(line: Column) -> Column:
    """FN07 as a column."""
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda f: F.trim(f, F.lit('"')))
