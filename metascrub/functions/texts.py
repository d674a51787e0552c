"""Texts of reports, sizes, GPS positions and options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of statuses.
STATUS_LABEL = {"ok": "✓", "clean": "✓", "skipped": "–", "error": "✗"}
#: Option defaults; a suffix loses these characters and control characters.
DEFAULTS = {"suffix": "_clean", "subfolder": False, "strip_icc": False, "keep_attachments": False, "remove_scripts": True, "topmost": False}
BAD_SUFFIX = r'[/\\:*?"<>|\x00-\x1F]'


def summary(status: Column, removed: Column, error: Column) -> Column:
    text = F.array_join(removed, ", ")
    #: The texts of statuses.
    return (F.when(status == "ok", F.coalesce(F.nullif(text, F.lit("")), F.lit("metadata removed"))).when(status == "clean", "no metadata found")
            .when(status == "skipped", "unsupported file type").otherwise(F.coalesce(F.nullif(error, F.lit("")), F.lit("failed"))))


def fmt_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, ties to even."""
    out, size = None, n.cast("double")
    one = lambda x: F.format_string("%.1f", F.bround(x, 1))
    for unit, low in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        told = F.concat(one(size / low), F.lit(f" {unit}"))
        out = F.when(n >= low, told) if out is None else out.when(n >= low, told)
    return out.otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))


def status_label(status: Column) -> Column:
    out = F.lit("?")
    for k, v in STATUS_LABEL.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def gps_text(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """Degrees, minutes and seconds of two arrays of three numbers; seconds are rounded half to even."""
    dms = lambda r, ref: F.concat(F.get(r, F.lit(0)).cast("int").cast("string"), F.lit("°"), F.get(r, F.lit(1)).cast("int").cast("string"), F.lit("'"), F.bround(F.get(r, F.lit(2)), 0).cast("int").cast("string"), F.lit('"'), F.coalesce(ref, F.lit("")))
    return F.concat(dms(lat, lat_ref), F.lit(", "), dms(lon, lon_ref))


def option(json: Column, key: str) -> Column:
    """An option of a JSON object; what is no object, no JSON or of another type gives the default."""
    default = DEFAULTS[key]
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    if isinstance(default, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).otherwise(F.lit(default))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    text = F.when(F.char_length(text) <= 64, text)
    return F.coalesce(F.nullif(F.regexp_replace(text, BAD_SUFFIX, ""), F.lit("")), F.lit(default))


def options(json: Column) -> Column:
    """The options of a JSON object as a struct, which rules read file by file (see ``operators.clean.clean_files``)."""
    return F.struct(*[option(json, k).alias(k) for k in DEFAULTS])
