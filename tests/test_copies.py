"""Files by path in, files under their names out."""

import os

import pytest
from pyspark.sql import functions as F

from metascrub.sources import copies, files, stores


def tree(root):
    return {os.path.relpath(os.path.join(d, x), root): open(os.path.join(d, x), "rb").read() for d, _, names in os.walk(root) for x in names if not x.endswith(".crc")}


def outputs(spark, n=40, start=0):
    rows = [(f"in/{i}", f"sub{i % 3}/f{i}_clean.bin", bytearray(bytes([i]) * i)) for i in range(start, n)]
    return spark.createDataFrame(rows, "path string, dst string, content binary").repartition(5)


def test_copies(spark, tmp_path):
    root = str(tmp_path / "out")
    assert files.write_copies(outputs(spark).unionByName(spark.createDataFrame([("x", "no.bin", None)], "path string, dst string, content binary")), root) == 40
    assert tree(root) == {f"sub{i % 3}/f{i}_clean.bin": bytes([i]) * i for i in range(40)}
    assert files.write_copies(outputs(spark).limit(0), root) == 0 and len(tree(root)) == 40


def test_failed_attempt_leaves_nothing(spark, tmp_path):
    """A task that fails after it has written some files: no file is left, under no name."""
    root = tmp_path / "out"
    bad = outputs(spark).withColumn("dst", F.when(F.col("path") == "in/39", F.raise_error(F.lit("killed"))).otherwise(F.col("dst")))
    with pytest.raises(Exception, match="killed"):
        files.write_copies(bad, str(root))
    assert not tree(root)
    for name in ("../x", "/etc/x", "", "a/../../x", "_staging/x"):
        with pytest.raises(Exception, match="below the target"):
            files.write_copies(outputs(spark, 1).withColumn("dst", F.lit(name)), str(root))
    assert not tree(root)


def test_taken_names(spark, tmp_path):
    """No file is written over; of two rows of one name one is told."""
    root = tmp_path / "out"
    (root / "sub0").mkdir(parents=True)
    (root / "sub0/f3_clean.bin").write_bytes(b"mine")
    with pytest.raises(FileExistsError, match="f3_clean"):
        files.write_copies(outputs(spark), str(root), "job")
    assert (root / "sub0/f3_clean.bin").read_bytes() == b"mine" and len([p for p in tree(root) if not p.startswith("_")]) == 40
    (root / "sub0/f3_clean.bin").unlink()
    files.write_copies(outputs(spark), str(root), "job")  # the same job goes on
    (root / "sub0/f3_clean.bin").write_bytes(b"changed by its owner")
    assert files.write_copies(outputs(spark), str(root), "job") == 40  # a job that is published changes nothing
    assert tree(root)["sub0/f3_clean.bin"] == b"changed by its owner" and set(tree(root)) == {f"sub{i % 3}/f{i}_clean.bin" for i in range(40)} | {"_published/job"}
    with pytest.raises(FileExistsError, match="x.bin"):
        files.write_copies(outputs(spark, 2).withColumn("dst", F.lit("x.bin")), str(root))


def test_recovery(spark, tmp_path):
    """A driver lost before the marker leaves nothing; one lost behind it loses nothing, whatever was moved already."""
    root = str(tmp_path / "out")
    copies.stage(outputs(spark), root, "late")
    copies.stage(outputs(spark, 60, 40), root, "early")
    (tmp_path / "out/_staging/early/committed").unlink()
    os.makedirs(tmp_path / "out/_staging/late/9-99")  # an attempt that lost the race
    (tmp_path / "out/_staging/late/9-99/00000000").write_bytes(b"loser")
    manifest = (tmp_path / "out/_staging/late/committed").read_text().split()[0]
    first = spark.read.parquet(manifest).first()
    fs, base = stores.opened(root)
    assert copies.place(fs, first.staged, f"{base}/{first.dst}") == "done" == copies.place(fs, first.staged, f"{base}/{first.dst}")
    assert copies.recover(spark, root) == {"late": 40, "early": 0}
    assert set(tree(root)) == {f"sub{i % 3}/f{i}_clean.bin" for i in range(40)} | {"_published/late"} and copies.recover(spark, root) == {}


def test_walk_and_read(spark, tmp_path):
    """Hidden names, a link that loops, a sparse file over the limit, one that is gone; one scan and balanced bins."""
    names = {"a.jpg": 10, ".hidden/_x.png": 20, "_y": 0, "s/t/.z": 7, "s/big.bin": 100}
    for name, n in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(os.urandom(n))
    os.symlink(tmp_path, tmp_path / "s/loop")
    with open(tmp_path / "s/sparse.bin", "wb") as f:
        f.truncate(3 << 30)
    found = files.walk(spark, str(tmp_path), str(tmp_path / "nothing"))
    assert {r.path[len(str(tmp_path)) + 1 :]: r.length for r in found.collect()} == {**names, "s/sparse.bin": 3 << 30}
    before = tree(tmp_path / ".hidden")
    listing = found.select("path", "length").unionByName(spark.createDataFrame([(f"file:{tmp_path}/gone", 5)], "path string, length long"))
    df = files.read(listing, size=120 + 3 * files.OPEN_COST)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "binaryFile" not in plan
    got = {r.path.rsplit("/", 1)[-1]: r for r in df.collect()}
    assert {k: r.error for k, r in got.items() if r.error} == {"sparse.bin": "file too large: sparse.bin", "gone": "file not found: gone"}
    assert all(bytes(got[n.rsplit("/", 1)[-1]].content) == (tmp_path / n).read_bytes() for n in names) and got["sparse.bin"].content is None
    assert files.read(listing.limit(0)).count() == 0 and tree(tmp_path / ".hidden") == before


def test_bins(spark):
    """Bins hold what they should, whatever the lengths; each file is in one."""
    lengths = [(f"f{i}", (i * 7919) % 1000 * 100_000) for i in range(500)]
    placed, n = files.bins(spark.createDataFrame(lengths, "path string, length long").repartition(3), 64 << 20)
    rows = placed.collect()
    held = {}
    for r in rows:
        held.setdefault(r.bin, []).append(r.length + files.OPEN_COST)
    assert len(rows) == 500 and set(held) == set(range(n))
    assert all(sum(x) <= 64 << 20 or len(x) == 1 for x in held.values()) and sum(sum(x) < 20 << 20 for x in held.values()) <= 3 + n // 10
