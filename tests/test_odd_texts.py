"""Registered queries against their DuckDB SQL over texts that the smallest tables don't have: empty, null, short and long ones."""

import duckdb
import pytest

from metascrub.plans import registry

TEXTS = ["", "", "", "a", "b", "c", "ab", "é", "ef", "abc", "aé", "xyz", "abcd", "efgh", "a--b", "x" * 59_999, "y" * 60_000, "z" * 120_001]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    def table(*more):
        at = tmp_path_factory.mktemp("odd")
        texts = ", ".join("null" if t is None else f"'{t}'" for t in [*TEXTS, *more])
        duckdb.sql(f"copy (select i as doc_id, t as text, 'en' as lang, 'web' as source, coalesce(length(t), 0)::bigint as n_chars from (select unnest(range({len(TEXTS) + len(more)})) as i, unnest([{texts}]) as t)) to '{at}/documents.parquet'")
        return str(at)

    return table


def compared(spark, name, folder):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    db.register("got", registry.QUERIES[name](spark, folder).toArrow())
    db.sql(f"create or replace temp table want as {registry.ORACLES[name]}")
    listed = ", ".join(f'"{c[0]}"' for c in db.sql("describe want").fetchall())
    return db.sql(f"(select {listed} from want except all select {listed} from got) union all (select {listed} from got except all select {listed} from want)").fetchall()


@pytest.mark.parametrize("name", ["jpeg_strip", "parts_explode"])
def test_empty_and_long_texts(spark, odd, name):
    """A JPEG of an empty text has no segment where parts are listed; a strip finds one of each kind."""
    assert not compared(spark, name, odd())


def test_short_artists(spark, odd):
    """Values of up to four bytes stand in a TIFF entry, longer ones behind the directories; a null text has no value."""
    assert not compared(spark, "tiff_identity_audit", odd(None, None, None))


def test_files_are_bounded(spark, odd, monkeypatch):
    """A folder of documents has no file over its bound, whatever the number of documents and the lengths; a null text has no length."""
    sizes, real = [], registry.fs.discover
    monkeypatch.setattr(registry.fs, "discover", lambda spark, *roots, **more: sizes.extend(r.length for r in real(spark, *roots).collect()) or real(spark, *roots, **more))
    assert not compared(spark, "src_discover", odd(None, *("w" * 60_000 for _ in range(300))))
    assert max(sizes) < 128 * 90_000 and sum(sizes) > 300 * 80_000
