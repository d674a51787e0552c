"""Connected components of an edge table, by alternating large and small stars, without any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge can reach. Loops and repeated edges do no harm; an
    empty table gives no rows. Each round is written to the shared folder; there are about log2(nodes) of them."""
    now = store.saved(_tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    mark = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours link to the least of the neighbourhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _tidy(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: smaller neighbours and the node itself link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = store.saved(_tidy(small), "edges")
        if (new := _mark(now)) == mark:
            break
        mark = new
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops.select("node", F.col("node").alias("component")))


def _tidy(edges: DataFrame) -> DataFrame:
    """From the larger node to the smaller one, each edge once."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
