"""Whole files are composed, cleaned and digested in one pass over their documents."""

import pytest
from test_clean import unpacked

from metascrub.operators import archives
from metascrub.plans import registry

DATA = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clean_office", "clean_odf"])
def test_packages_once(spark, name):
    """Packed, split, packed again and digested once each, with one exchange of the documents."""
    plan = planned(registry.QUERIES[name](spark, DATA))
    assert plan.count("MapInArrow") == 4 and plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "InArrow" not in plan.replace("MapInArrow", "")


def test_mixed_folder_once(spark):
    plan = planned(registry._mixed_files(spark, DATA))
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1 and plan.count("MapInArrow") == 1


def test_lists_and_digests(spark):
    """Archives of arrays in the order of their numbers, none for a null; digests of what is no archive are null."""
    rows = [(1, [(1, "b", bytearray(b"2")), (0, "a", bytearray(b"1")), (2, "d/", None)]), (2, None), (3, [])]
    packed = archives.pack_lists(spark.createDataFrame(rows, "k int, parts array<struct<part_seq int, part_name string, data binary>>"), "k")
    got = {r.k: r.content for r in packed.collect()}
    assert unpacked(got[1]) == [("a", b"1"), ("b", b"2")] and got[2] is None
    told = {r.k: (r.n_parts, r.digest) for r in archives.digests(packed).collect()}
    assert told == {1: (2, "f2e49af795161e14acf9d9245473a368"), 2: (None, None), 3: (None, None)}
