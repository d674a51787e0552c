"""PDF rules over a table of entries (doc_id, parent, key, node, value): node is parent and key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys by rule.
METADATA = ["/Metadata", "/PieceInfo"]
SCRIPTS = ["/JS", "/JavaScript"]
FORM_VALUES = ["/V", "/DV", "/TU", "/TM"]
ANNOTATION = ["/Author", "/T", "/RC", "/NM", "/CreationDate", "/M", "/Subj"]
ACTIONS = r"/(?:A|OpenAction)$|/AA/[^/]+$"


def actions(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Action nodes whose /S child runs code or a program."""
    runs = entries.filter((F.col("key") == "/S") & F.col("value").isin("/JavaScript", "/Launch")).select(*keys, F.col("parent").alias("node"))
    return entries.filter(F.col("node").rlike(ACTIONS)).join(runs, [*keys, "node"], "left_semi")


def removals(entries: DataFrame, keys: list[str], remove_scripts: bool = True, remove_attachments: bool = True) -> DataFrame:
    """(keys, node, category) of the nodes that rules name."""
    e, key, parent = entries, F.col("key"), F.col("parent")
    named = lambda where, what: e.filter(where).select(*keys, "node", F.lit(what).alias("category"))
    found = [
        named(parent == "Info", "document info"), named(key.isin(METADATA), "metadata"), named(parent.rlike("^Root/AcroForm/Fields/[0-9]+$") & key.isin(FORM_VALUES), "form values"),
        named(parent.rlike("/Annots/[0-9]+$") & key.isin(ANNOTATION), "annotations"), named(parent.rlike("^Root/Outlines(?:/First|/Next)*$") & (key == "/NM"), "outline"),
    ]
    if remove_attachments:
        found.append(named((parent == "Root/Names") & (key == "/EmbeddedFiles"), "attachments"))
    if remove_scripts:
        found += [named(key.isin(SCRIPTS), "scripts"), named((parent == "Root/AcroForm") & (key == "/XFA"), "scripts"), actions(e, keys).select(*keys, "node", F.lit("scripts").alias("category"))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def drop_subtrees(entries: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """entries without the removed nodes and all below them: an anti join on the ancestors of each node (at most its depth)."""
    ancestors = entries.withColumn("_above", F.explode(F.expr("transform(sequence(1, size(split(node, '/'))), k -> array_join(slice(split(node, '/'), 1, k), '/'))")))
    hit = ancestors.join(removed.select(*keys, F.col("node").alias("_above")).distinct(), [*keys, "_above"], "left_semi").select(*keys, "node").distinct()
    return entries.join(hit, [*keys, "node"], "left_anti")


def docinfo(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, removed): the document-info keys in order of seq, as the report tells them."""
    rows = entries.filter("parent = 'Info'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "key"))).alias("_k"))
    return rows.select(*keys, F.concat(F.lit("document info ("), F.array_join(F.transform("_k", lambda x: x["key"]), ", "), F.lit(")")).alias("removed"))


def zeroed_ids(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, new_value): file identifiers of the trailer, and the zeros that replace them."""
    return entries.filter("parent = 'Trailer' and key = '/ID'").select(*keys, "node", F.repeat(F.lit("00"), 16).alias("new_value"))
