"""Row shapes and on-disk constants of the filesystem model."""

from __future__ import annotations

from pyspark.sql import types as T

ROOT = 5
RECORD_MASK = 0x0000FFFFFFFFFFFF
#: 100 ns ticks between 1601-01-01 and 1970-01-01.
EPOCH = 116_444_736_000_000_000
TICKS = 10_000_000

# File attribute bits.
ATTRIBUTES = {
    "readonly": 0x1, "hidden": 0x2, "system": 0x4, "directory": 0x10, "archive": 0x20, "device": 0x40, "normal": 0x80, "temporary": 0x100,
    "sparse": 0x200, "reparse_point": 0x400, "compressed": 0x800, "offline": 0x1000, "not_content_indexed": 0x2000, "encrypted": 0x4000,
}

# Change journal reason bits.
REASONS = {
    "data_overwrite": 0x1, "data_extend": 0x2, "data_truncation": 0x4, "named_data_overwrite": 0x10, "named_data_extend": 0x20,
    "named_data_truncation": 0x40, "file_create": 0x100, "file_delete": 0x200, "ea_change": 0x400, "security_change": 0x800,
    "rename_old_name": 0x1000, "rename_new_name": 0x2000, "indexable_change": 0x4000, "basic_info_change": 0x8000, "hard_link_change": 0x10000,
    "compression_change": 0x20000, "encryption_change": 0x40000, "object_id_change": 0x80000, "reparse_point_change": 0x100000,
    "stream_change": 0x200000, "close": 0x80000000,
}


def _struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in text.split(","))])


NODES = _struct("drive string,record_number long,parent_record_number long,file_reference_number long,name string,file_size long,allocated_size long,attributes long,is_directory boolean,creation_time long,modification_time long,source string")
CHANGES = _struct("drive string,record_number long,parent_record_number long,name string,reason string,reason_bits long,attributes long,usn long,timestamp long")
TREEMAP = _struct("drive string,record_number long,parent_record_number long,name string,size long,is_directory boolean,depth int,x double,y double,w double,h double,children_rendered boolean")
OVERLAY = _struct("file_reference_number long,file_size long,creation_time long,modification_time long")
