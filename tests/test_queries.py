"""Every registered query of the library against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from metascrub.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    assert got.num_rows
    if name not in registry.ORACLES:
        return
    db.register("got", got)
    db.sql(f"create or replace temp table want as {registry.ORACLES[name]}")
    columns = sorted(c[0] for c in db.sql("describe got").fetchall())
    assert columns == sorted(c[0] for c in db.sql("describe want").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    differ = db.sql(f"(select {listed} from want except all select {listed} from got) union all (select {listed} from got except all select {listed} from want)")
    assert not differ.fetchall()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
