"""Rows of conversations in order, dealt by ranges, so that one conversation may be in many parts and no part grows with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascrub.llm import store


def dealt(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with ``part``, written; by part and keys (nulls first) they are in order. Rows equal in all keys are dealt apart as well.

    The rows are written once before, as ranges are found by a sample that would compute them twice."""
    rows = store.saved(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    order = [F.col(k).asc_nulls_first() for k in [*keys, "_tie"]]
    return store.saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), f"{name}-parts")


def in_order(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Each part in order in one task, for helpers that walk over the rows."""
    return parts.repartition("part").sortWithinPartitions("part", *[F.col(k).asc_nulls_first() for k in [*keys, "_tie"]])


def shared(parts: DataFrame, key: str) -> DataFrame:
    """(key, parts) of the keys that are in several parts: a list of at most as many numbers as there are parts. Each part
    shares at most its first and its last key with others, so these are at most twice as many rows as parts."""
    each = parts.select(key, "part").distinct()
    return each.groupBy(key).agg(F.sort_array(F.collect_list("part")).alias("parts")).filter(F.size("parts") > 1)


def turn_hash(role: Column, text: Column) -> Column:
    """32 bytes that tell (role, text) from every other pair."""
    return F.unhex(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256))
