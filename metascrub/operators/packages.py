"""Office and OpenDocument packages as tables of parts: ordered rules, rewriting, names and limits."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metascrub.operators import rewrite as rw


class Rule(NamedTuple):
    """test: SQL over low, the lower-cased name; the first rule that holds wins."""

    test: str
    action: str
    category: str


#: The order of the rules, their actions and report categories.
OOXML = [
    Rule("low = 'docprops/core.xml'", "template", "document properties"), Rule("low = 'docprops/app.xml'", "template", "app properties"), Rule("low = 'docprops/custom.xml'", "template", "custom properties"),
    Rule("low = 'word/comments.xml'", "drop", "document comments"), Rule("low = 'word/commentauthors.xml'", "drop", "comment author list"), Rule("low = 'word/commentsextended.xml'", "drop", "extended comment metadata"),
    Rule("low = 'word/commentsids.xml'", "drop", "comment-to-paragraph mapping"), Rule("low = 'ppt/commentsauthors.xml'", "drop", "comment author list"), Rule("left(low, 13) = 'ppt/comments/'", "drop", "PPTX comments"),
    Rule("left(low, 16) = 'ppt/notesslides/'", "drop", "PPTX notes"), Rule("left(low, 17) = 'xl/externallinks/'", "drop", "XLSX links"), Rule("left(low, 11) = 'xl/comments' and right(low, 4) = '.xml'", "drop", "XLSX comments"),
    Rule("low = 'xl/authors.xml'", "drop", "comment author list"), Rule("left(low, 15) = '_xmlsignatures/'", "drop", "signatures"),
    Rule("right(low, 14) = 'vbaproject.bin' or right(low, 23) = 'vbaprojectsignature.bin' or right(low, 12) = '/vbadata.xml'", "drop", "macros"),
    Rule("left(low, 10) = 'customxml/'", "drop", "custom XML"),
    Rule("right(low, 4) in ('.wmf', '.emf') and (left(low, 9) = 'docprops/' or left(low, 5) = 'word/' or left(low, 3) = 'xl/' or left(low, 4) = 'ppt/')", "drop", "thumbnails"),
    Rule("(left(low, 9) = 'docprops/' or left(low, 5) = 'word/' or left(low, 3) = 'xl/' or left(low, 4) = 'ppt/') and (right(low, 4) in ('.jpg', '.jpe', '.png') or right(low, 5) in ('.jpeg', '.jfif', '.webp'))", "strip", "images"),
    Rule("right(low, 4) = '.xml' or right(low, 5) = '.rels'", "rewrite", "xml"),
]
ODF = [
    Rule("low = 'meta.xml'", "template", "document metadata"), Rule("low = 'content.xml'", "rewrite", "content"), Rule("low = 'settings.xml'", "rewrite", "settings"), Rule("low = 'mimetype'", "keep", "mimetype"),
    Rule("left(low, 6) = 'basic/' or left(low, 8) = 'scripts/'", "drop", "macros"), Rule("left(low, 11) = 'thumbnails/'", "drop", "unreported"), Rule("left(low, 9) = 'customui/'", "drop", "custom UI"),
]
MACROS = {"ooxml": OOXML[14].test, "odf": ODF[4].test}
MEDIA = OOXML[17].test

#: What replaces property parts.
TEMPLATES = {
    "docprops/core.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><dc:creator></dc:creator><cp:lastModifiedBy></cp:lastModifiedBy></cp:coreProperties>',
    "docprops/app.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties" xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"><Application></Application></Properties>',
    "docprops/custom.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"/>',
    "meta.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<office:document-meta\n  xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0"\n  xmlns:meta="urn:oasis:names:tc:opendocument:xmlns:meta:1.0"\n  xmlns:dc="http://purl.org/dc/elements/1.1/">\n  <office:meta>\n    <dc:creator></dc:creator>\n    <meta:initial-creator></meta:initial-creator>\n    <dc:date></dc:date>\n    <meta:creation-date></meta:creation-date>\n    <meta:editing-cycles>1</meta:editing-cycles>\n    <meta:editing-duration>PT0S</meta:editing-duration>\n  </office:meta>\n</office:document-meta>',
}


def dispatch(parts: DataFrame, rules: list[Rule], remove_scripts: bool = True, name: str = "part_name") -> DataFrame:
    """parts with action (keep where no rule holds) and category of the first rule that holds."""
    rules = [r for r in rules if remove_scripts or r.category != "macros"]
    return parts.withColumn("low", F.lower(name)).withColumn("action", F.expr(first(rules, "action", "'keep'"))).withColumn("category", F.expr(first(rules, "category", "null"))).drop("low")


def first(rules: list[Rule], pick: str, rest: str, macros: str = "true") -> str:
    """SQL for a field of the first rule that holds; rules on macros hold where ``macros`` does."""
    test = lambda r: r.test if macros == "true" or r.category != "macros" else f"({r.test}) and {macros}"
    return "case " + " ".join(f"when {test(r)} then '{getattr(r, pick)}'" for r in rules) + f" else {rest} end"


def first_match(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """parts with action by a table of rules (prefix, priority, action): of all rules whose prefix the lower-cased name starts with the
    one of least priority, then action; a null priority comes last, and without a rule a part is kept.

    The rules are an index by prefix length: of each prefix the best rule, and for each length that occurs one look-up of the name's
    first characters in a hash table, with the best one kept on the way. The look-ups are equality joins, so Spark sends a
    small rule table to all tasks and deals a large one; parts are not sorted, grouped or multiplied."""
    best = rules.groupBy("prefix").agg(F.min(F.struct(F.col("priority").isNull().alias("last"), "priority", "action")).alias("_rule"))
    lengths = sorted(r[0] for r in rules.filter("prefix is not null").select(F.char_length("prefix")).distinct().collect())  # as many as names have characters at most
    found = parts.withColumn("_low", F.lower("part_name"))
    for n in lengths:
        own = best.filter(F.char_length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("_rule").alias(f"_r{n}"))
        found = found.join(own, F.left("_low", F.lit(n)) == F.col(f"_p{n}"), "left")
    picked = F.least(*[F.col(f"_r{n}") for n in lengths]) if len(lengths) > 1 else F.col(f"_r{lengths[0]}") if lengths else F.struct(F.lit(None).cast("string").alias("action"))
    return found.select(*[c for c in parts.columns if c != "action"], F.coalesce(picked["action"], F.lit("keep")).alias("action"))


def rewrite_ooxml(parts: DataFrame, remove_scripts: bool | Column = True) -> DataFrame:
    """parts with new_data and n_rsid, n_track_changes, n_comment_ranges: the cumulative rewrites of XML and relation parts."""
    low = F.lower(F.col("part_name"))
    xml, types, rels = low.endswith(".xml"), low == "[content_types].xml", low.endswith(".rels")
    df = parts.withColumn("new_data", F.col("data"))
    df = df.withColumn("n_rsid", F.when(xml, rw.count(F.col("new_data"), rw.RSID) + rw.count(F.col("new_data"), rw.RSIDS)).otherwise(0))
    df = df.withColumn("new_data", F.when(xml, rw.drop(rw.drop(F.col("new_data"), rw.RSID), rw.RSIDS)).otherwise(F.col("new_data")))
    df = df.withColumn("n_track_changes", F.when(xml, rw.count(F.col("new_data"), rw.AUTHOR) + rw.count(F.col("new_data"), rw.DATE)).otherwise(0))
    df = df.withColumn("new_data", F.when(xml, rw.drop(rw.drop(F.col("new_data"), rw.AUTHOR), rw.DATE)).otherwise(F.col("new_data")))
    df = df.withColumn("n_comment_ranges", F.when(xml, rw.count(F.col("new_data"), rw.COMMENT_RANGE)).otherwise(0))
    df = df.withColumn("new_data", F.when(xml, rw.drop(F.col("new_data"), rw.COMMENT_RANGE)).otherwise(F.col("new_data")))
    for where, pattern in (((types | rels) & (remove_scripts if isinstance(remove_scripts, Column) else F.lit(remove_scripts)), rw.VBA_REF), (types | rels, rw.CUSTOMXML_REF), (rels, rw.RELS_REF), (types, rw.TYPES_REF)):
        df = df.withColumn("new_data", F.when(where, rw.drop(F.col("new_data"), pattern)).otherwise(F.col("new_data")))
    return df


def templated(name: Column, data: Column) -> Column:
    """data, or the fixed template of a property part."""
    out = data
    for k, v in TEMPLATES.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out


def rewrite_odf(parts: DataFrame) -> DataFrame:
    """parts with new_data and n_changes, n_annotations, n_settings."""
    low = F.lower(F.col("part_name"))
    df = rw.strip(parts.withColumn("_c", F.when(low == "content.xml", F.col("data"))), "_c", {"changes": rw.ODF_CHANGES, "annotations": [rw.ODF_ANNOTATION]})
    df = rw.strip(df.withColumn("_s", F.when(low == "settings.xml", F.col("data"))), "_s", {"settings": [rw.ODF_SETTINGS]})
    zero = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("n_changes", "n_annotations", "n_settings")}
    return df.withColumns(zero).withColumn("new_data", templated(F.col("part_name"), F.coalesce("_c", "_s", "data"))).drop("_c", "_s")


def unsafe_name(name: Column) -> Column:
    """Why an entry name is unsafe, or null; the first rule that fails."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return (F.when((name == "") | (F.char_length(name) > 512), "bad length").when(name.startswith("/") | name.startswith("\\"), "absolute path")
            .when(name.rlike("^[A-Za-z]:"), "drive letter").when(F.instr(name, F.char(F.lit(0))) > 0, "NUL").when(F.array_contains(parts, ".."), "parent folder"))


def limits(parts: DataFrame, key: str, size: str, entries: int = 20_000, each: int = 512 << 20, total: int = 1 << 30) -> DataFrame:
    """(key, n_entries, largest, total, verdict) of each archive; verdict null is fine."""
    df = parts.groupBy(key).agg(F.count("*").alias("n_entries"), F.max(size).alias("largest"), F.sum(size).alias("total"))
    verdict = F.when(F.col("n_entries") > entries, "too many entries").when(F.col("largest") > each, "entry too large").when(F.col("total") > total, "archive too large")
    return df.withColumn("verdict", verdict)


def last_copy(parts: DataFrame, key: str) -> DataFrame:
    """Of entries with one name in an archive every one gets the bytes of the last."""
    frame = Window.partitionBy(key, "part_name").orderBy("part_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.withColumn("data", F.last("data").over(frame))


def kept(parts: DataFrame) -> DataFrame:
    """The entries of the copy: neither dropped nor folders."""
    return parts.filter((F.col("action") != "drop") & ~F.col("part_name").endswith("/"))
