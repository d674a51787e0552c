"""Rewriting of markup by ordered patterns: each step counts on what the steps before have left, then removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of what is removed, by step, as Java and RE2 read them.
MARKUP = {
    "metadata": r"(?s)<metadata[^>]*>.*?</metadata>",
    "comments": r"(?s)<!--.*?-->",
    "scripts": r"(?s)<script[^>]*>.*?</script>",
    "editor": r"(?s)<(?:inkscape|sodipodi|illustrator|adobe|dc|cc)[^>]*>.*?</(?:inkscape|sodipodi|illustrator|adobe|dc|cc)[^>]*>",
}
#: Patterns of instructions, embedded images, Word and relation parts, OpenDocument parts and property fields.
PI = r"<\?[^>]*\?>"
EMBEDDED = r'<image[^>]*(?:xlink:href|href)\s*=\s*"data:image/[^"]*"[^>]*>'
RSID, RSIDS = r'\s+w:rsid\w*="[0-9A-Fa-f]*"', r"(?s)<w:rsids[^>]*>.*?</w:rsids>"
AUTHOR, DATE = r'\s+w:author="[^"]*"', r'\s+w:date="[^"]*"'
COMMENT_RANGE = r"<w:comment(?:Range(?:Start|End)|Reference)[^>]*/?>"
VBA_REF = r"(?i)<\s*(?:Override|Relationship)\b[^>]*(?:vbaproject|vbadata)[^>]*>"
CUSTOMXML_REF = r"(?i)<\s*(?:Override|Relationship)\b[^>]*customxml[^>]*>"
RELS_REF = r"(?i)<\s*Relationship\b[^>]*(?:comments|notesSlide|commentAuthors|externalLink|digital-signature|_xmlsignatures)[^>]*>"
TYPES_REF = r"(?i)<\s*Override\b[^>]*(?:digsig|xml-signature|notesSlide|comment|externalLink)[^>]*>"
ODF_CHANGES = [
    r"(?s)<text:changed-region[^>]*>.*?</text:changed-region>", r'<text:change-start[^>]*\s+dc:creator="[^"]*"[^>]*/?>', r'<text:change-start[^>]*\s+dc:date="[^"]*"[^>]*/?>',
    r'<text:change[^>]*\s+dc:creator="[^"]*"[^>]*/?>', r'<text:change[^>]*\s+dc:date="[^"]*"[^>]*/?>', r"<text:change-end[^>]*/?>",
]
ODF_ANNOTATION = r"(?s)<text:annotation[^>]*>.*?</text:annotation>"
ODF_SETTINGS = r'<config:config-item[^>]*config:name="(?:Author|Company|User)[^>]*>[^<]*</config:config-item>'
CORE_FIELD = r"(?i)<(?:dc|cp|dcterms):(creator|lastModifiedBy|title|description|subject|keywords|category|contentStatus|created|modified|identifier|language|version|revision)\b[^>]*>\s*([^<]*)"
APP_FIELD = r"(?i)<(Company|Manager|Application|AppVersion|HyperlinkBase|TotalTime|PresentationFormat|Notes|Security)\b[^>]*>\s*([^<]*)"
ODF_FIELDS = {
    "creator": r"(?i)<dc:creator[^>]*>([^<]+)", "initial-creator": r"(?i)<meta:initial-creator[^>]*>([^<]+)", "date": r"(?i)<dc:date[^>]*>([^<]+)",
    "creation-date": r"(?i)<meta:creation-date[^>]*>([^<]+)", "title": r"(?i)<dc:title[^>]*>([^<]+)", "description": r"(?i)<dc:description[^>]*>([^<]+)",
    "subject": r"(?i)<dc:subject[^>]*>([^<]+)", "keyword": r"(?i)<meta:keyword[^>]*>([^<]+)", "document-statistic": r"(?i)<meta:document-statistic[^>]*>", "generator": r"(?i)<meta:generator[^>]*>([^<]+)",
}


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def drop(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def strip(df: DataFrame, column: str, steps: dict[str, list[str]]) -> DataFrame:
    """df with the column rewritten and n_<step> of each step: matches of its patterns, each removed before the next."""
    for step, patterns in steps.items():
        total = F.lit(0)
        for i, pattern in enumerate(patterns):
            n = f"_n{i}"
            df = df.withColumn(n, count(F.col(column), pattern)).withColumn(column, drop(F.col(column), pattern))
            total = total + F.col(n)
        df = df.withColumn(f"n_{step}", total).drop(*[f"_n{i}" for i in range(len(patterns))])
    return df


def drop_instructions(df: DataFrame, column: str) -> DataFrame:
    """Processing instructions go if there is more than one; a leading ``<?xml`` stays. n_pi counts those that went."""
    text = F.col(column)
    n, first = count(text, PI), F.regexp_extract(text, PI, 0)
    df = df.withColumns({"_n": n, "_first": first, "_at": F.instr(text, first)}).withColumn("_keep", F.col("_first").startswith("<?xml"))
    end = F.when(F.col("_keep"), F.col("_at") + F.char_length("_first") - 1).otherwise(0)
    text = F.concat(F.left(text, end), drop(F.substr(text, end + 1), PI))
    more = F.col("_n") > 1
    return df.withColumn(column, F.when(more, text).otherwise(F.col(column))).withColumn("n_pi", F.when(more, F.col("_n") - F.col("_keep").cast("int")).otherwise(0)).drop("_n", "_first", "_at", "_keep")


def scrub_markup(df: DataFrame, column: str) -> DataFrame:
    """df with the column cleaned, n_* of each step, removed (report texts in order) and status (ok, or clean if nothing
    was removed; then the text is as before). A null text stays null, with status clean."""
    df = strip(df, column, {k: [v] for k, v in MARKUP.items()})
    df = drop_instructions(df, column).withColumn("n_embedded", count(F.col(column), EMBEDDED))
    #: Report texts, in order.
    told = lambda n, text: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(text)))
    removed = F.array_compact(F.array(F.when(F.col("n_metadata") > 0, "metadata block"), told("n_comments", " comment(s)"), F.when(F.col("n_scripts") > 0, "script block(s)"), told("n_editor", " editor metadata block(s)"), told("n_pi", " processing instruction(s)"), told("n_embedded", " embedded image(s) present (metadata not scrubbed)")))
    return df.withColumn("removed", removed).withColumn("status", F.when(F.size("removed") > 0, "ok").otherwise("clean"))


def fields(text: Column, pattern: str) -> Column:
    """Sorted distinct names of non-blank properties."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("v"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda x: F.trim(x["v"]) != ""), lambda x: x["k"])))


def odf_fields(text: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in ODF_FIELDS.items()])))
