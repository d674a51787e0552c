"""Path parts and routing by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supported extensions by family.
FORMATS = {
    "image": [".jpg", ".jpeg", ".jfif", ".jpe", ".png", ".tif", ".tiff", ".webp", ".gif", ".bmp", ".heic", ".heif", ".avif", ".svg"],
    "pdf": [".pdf"],
    "office": [".docx", ".xlsx", ".pptx"],
    "odf": [".odt", ".ods", ".odp"],
}
SUPPORTED = [e for group in FORMATS.values() for e in group]
EXT = r"(?s)^\.*[^.].*?(\.[^.]*)$"


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext(path: Column) -> Column:
    """The extension as written; leading dots of a name start none."""
    return F.regexp_extract(base(path), EXT, 1)


def stem(path: Column) -> Column:
    return F.left(base(path), F.char_length(base(path)) - F.char_length(ext(path)))


def folder(path: Column) -> Column:
    return F.when(F.instr(path, F.lit("/")) == 0, "").otherwise(F.left(path, F.char_length(path) - F.char_length(base(path)) - 1))


def family(path: Column) -> Column:
    """image, pdf, office, odf or null."""
    low, out = F.lower(ext(path)), F.lit(None).cast("string")
    for name, group in FORMATS.items():
        out = F.when(low.isin(group), name).otherwise(out)
    return out


def unsupported(path: Column) -> Column:
    """The message for a path without a family, else null."""
    low = F.lower(ext(path))
    return F.when(family(path).isNull(), F.concat(F.lit("unsupported file type: "), F.when(low == "", "(none)").otherwise(low)))
