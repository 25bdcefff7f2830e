"""Fixed lookup tables by file extension, and the columns made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(table: dict[str, str]) -> dict[str, str]:
    return {ext: value for exts, value in table.items() for ext in exts.split()}


# Type labels.
TYPE_LABELS = _spread({
    "exe": "Application", "dll": "DLL Library", "sys drv": "System File", "bat cmd": "Batch File", "msi": "Installer", "com scr": "Executable",
    "txt": "Text File", "log": "Log File", "md": "Markdown", "pdf": "PDF Document", "doc docx": "Word Document", "xls xlsx": "Spreadsheet",
    "ppt pptx": "Presentation", "png": "PNG Image", "jpg jpeg": "JPEG Image", "gif": "GIF Image", "bmp": "Bitmap Image", "svg": "SVG Image",
    "webp": "WebP Image", "ico": "Icon", "mp3": "MP3 Audio", "wav": "WAV Audio", "flac": "FLAC Audio", "ogg": "OGG Audio", "mp4": "MP4 Video",
    "avi": "AVI Video", "mkv": "MKV Video", "mov": "MOV Video", "zip": "ZIP Archive", "7z": "7-Zip Archive", "rar": "RAR Archive",
    "tar": "TAR Archive", "gz": "GZip Archive", "xz": "XZ Archive", "rs": "Rust Source", "py": "Python Script", "java": "Java Source",
    "jar": "Java Archive", "class": "Java Class", "c": "C Source", "cpp": "C++ Source", "h hpp": "Header File", "cs": "C# Source",
    "go": "Go Source", "js": "JavaScript", "ts": "TypeScript", "json": "JSON", "xml": "XML Document", "html htm": "HTML", "css": "Stylesheet",
    "yaml yml": "YAML", "toml": "TOML", "ini cfg conf": "Configuration",
})

# Name colours.
NAME_COLOURS = _spread({
    "java jar class": "Red", "py pyc pyw pyx": "Yellow", "exe dll bat cmd msi com scr sys drv": "Cyan", "xml html htm json yaml yml toml css": "Green",
    "svg png jpg jpeg gif bmp ico webp tiff": "Magenta", "rs go c cpp h hpp cs js ts": "LightBlue", "zip tar gz bz2 7z rar xz": "LightRed",
    "pdf doc docx xls xlsx ppt pptx": "LightYellow", "md txt log ini cfg conf": "Gray",
})

# Icons.
ICONS = _spread({
    "exe msi com": "⚙️", "dll sys drv": "🔧", "bat cmd": "⚙️", "txt log": "📝", "md": "📃", "pdf": "📕", "zip tar gz 7z rar xz": "📦",
    "png jpg jpeg gif bmp webp tiff": "🖼️", "svg": "🌉", "mp3 wav flac ogg": "🎵", "mp4 avi mkv mov": "🎬", "py": "🐍", "rs": "🦀",
    "java jar": "☕", "js ts html xml json": "🌐", "c cpp h hpp": "📄", "ini cfg conf toml yaml yml": "⚙️",
})
FOLDER_ICON, FILE_ICON = "📁", "📄"

# Treemap fills, red green blue. The last two classes only exist in the character-cell profile.
LEAF_COLOURS = _spread({
    "exe com scr": "200,55,55", "dll sys drv ocx": "175,65,65", "msi bat cmd ps1": "185,80,50", "zip rar 7z gz tar xz bz2 cab iso": "200,175,35",
    "mp4 mkv avi mov wmv flv webm m4v ts": "160,45,195", "mp3 wav flac ogg aac wma m4a opus": "35,175,135",
    "jpg jpeg png gif bmp tiff webp ico svg psd raw cr2 nef dng": "195,125,35", "pdf": "200,50,50", "doc docx odt rtf": "55,130,200",
    "xls xlsx ods csv": "45,165,65", "ppt pptx odp": "200,105,35", "txt log md cfg ini conf yml yaml toml": "120,120,120",
    "rs go c cpp h hpp cs": "75,150,220", "py pyw": "55,140,185", "js jsx tsx": "215,195,45", "java kt scala": "170,100,55",
    "html htm css scss": "215,75,45", "json xml sql": "140,160,55", "pak rpf bdt pack assets resource forge wad": "185,75,165",
    "vdi vmdk vhd vhdx qcow2 img bin 001": "100,65,165", "db sqlite mdf ldf bak": "135,115,45", "ttf otf woff woff2": "160,140,100",
    "stream streamdb": "155,55,125", "mft": "200,145,35",
})
FOLDER_FILLS = ["40,105,135", "50,115,120", "60,95,145", "45,125,110", "55,108,128"]
DEPTH_BORDERS = ["0,190,230", "90,200,70", "230,190,40", "210,90,200", "70,140,240", "230,130,50", "130,210,180"]
DEPTH_BACKGROUNDS = ["8,22,28", "12,24,10", "26,22,8", "24,12,24", "10,16,30", "26,16,8", "12,24,20"]

# Names of phases and filter modes, in the order they cycle.
PHASES = ["Initializing", "USN Enumeration", "MFT Reading", "Building Tree", "Calculating Sizes", "Complete"]
DATE_MODES = ["None", "After", "Before", "Between"]
SIZE_MODES = ["None", ">", "<", "Between"]
# The labels of the columns that results are sorted by.
SORT_LABELS = {"name": "Name", "path": "Path", "size": "Size", "extension": "Ext", "date": "Date Modified", "type": "Type"}


def cycled(modes: list[str], mode: str, step: int = 1) -> str:
    """The mode after (or before) another (FN25)."""
    return modes[(modes.index(mode) + step) % len(modes)]


def _map(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def type_label(is_directory: Column, extension: Column) -> Column:
    """FN10"""
    return F.when(is_directory, "Folder").otherwise(F.coalesce(_map(TYPE_LABELS, extension), F.lit("File")))


def name_colour(extension: Column) -> Column:
    """FN11"""
    return F.coalesce(_map(NAME_COLOURS, extension), F.lit("White"))


def icon(is_directory: Column, extension: Column) -> Column:
    """FN12"""
    return F.when(is_directory, FOLDER_ICON).otherwise(F.coalesce(_map(ICONS, extension), F.lit(FILE_ICON)))


def depth_colour(depth: Column, palette: list[str] | None = None) -> Column:
    """FN16"""
    palette = palette or DEPTH_BORDERS
    return F.element_at(F.array(*map(F.lit, palette)), (F.pmod(depth, F.lit(len(palette))) + 1).cast("int"))


def known_leaf_colour(extension: Column) -> Column:
    """The fixed part of FN13; null where the colour comes from a hash of the extension."""
    return _map(LEAF_COLOURS, extension)


def folder_fill(index: Column) -> Column:
    return depth_colour(index, FOLDER_FILLS)
