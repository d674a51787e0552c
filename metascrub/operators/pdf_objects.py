"""Indirect objects of PDF files as a graph: edges (keys, obj, key, target) say which object's key holds which other object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.operators import pdf_entries
from metascrub.sources import stores

DEPTH = 64  #: levels of objects that are followed

#: Keys whose targets go, by rule.
GONE = pdf_entries.METADATA + pdf_entries.SCRIPTS


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, obj, level) of the objects that can be reached from roots (keys, obj), each once, with its least number of steps.

    Each round follows the edges of what the round before has found, and leaves out what is known: cycles end, and an object that
    several others hold is visited once. A round's objects are written, so rounds neither grow the plan nor are run again."""
    edges = edges.select(*keys, "obj", F.col("target").alias("_to")).distinct()
    front = stores.saved(roots.select(*keys, "obj").distinct().withColumn("level", F.lit(0)), "objects")
    found = front
    for level in range(1, depth + 1):
        new = front.join(edges, [*keys, "obj"]).select(*keys, F.col("_to").alias("obj")).distinct().join(found, [*keys, "obj"], "left_anti")
        front = stores.saved(new.withColumn("level", F.lit(level)), "objects")
        if not front.take(1):
            break
        found = found.unionByName(front)
    return found


def code_actions(edges: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Edges to actions that run code or a program: their target is in runs (keys, obj)."""
    named = edges.filter(F.col("key").isin("/A", "/OpenAction") | F.col("key").startswith("/AA"))
    return named.join(runs.select(*keys, F.col("obj").alias("target")).distinct(), [*keys, "target"], "left_semi").select(edges.columns)


def kept(edges: DataFrame, roots: DataFrame, gone: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, obj, level) of the objects of the copy: what can be reached without the edges in gone. An object below a removed key
    stays where a kept one holds it as well."""
    return reachable(edges.join(gone.select(*keys, "obj", "key", "target").distinct(), [*keys, "obj", "key", "target"], "left_anti"), roots, keys, depth)
