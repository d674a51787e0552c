"""The drop box over batches, restarts and repeated batches, against one batch; the queue against its batch form."""

import os
import random

import pytest
from test_clean import mixed
from test_copies import tree
from test_files import PLAIN

from metascrub.streaming import dropbox


def box(spark, at):
    return dropbox.DropBox(spark, str(at / "out"), str(at / "book"), compact=2)


def put(folder, *names):
    files = dict(mixed())
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(files[n.rsplit("/", 1)[-1]])


def state(at):
    return {p: b for p, b in tree(at / "out").items() if not p.startswith("_published")}


def test_drop_box(spark, tmp_path):
    """Two batches with a restart, a batch that is run again, and all in one batch: the same names, bytes, reports and counts."""
    first, second = ["1/a.docx", "1/c.jpg", "1/e.txt"], ["2/b.odt", "2/c.jpg", "2/d.svg", "2/f.png"]
    at = tmp_path / "two"
    for names in (first, second):
        put(tmp_path / "in", *names)
        box(spark, at).start(str(tmp_path / "in/*"), str(at / "log")).awaitTermination()
    got, files = sorted(map(str, box(spark, at).reports().drop("batch").collect())), state(at)
    assert set(files) == {"a_clean.docx", "c_clean.jpg", "c_clean_1.jpg", "b_clean.odt", "d_clean.svg"} and files["c_clean_1.jpg"] == PLAIN
    df = spark.read.format("binaryFile").load(str(tmp_path / "in/2")).select("path", "content")
    box(spark, at).batch(df, 1)  # again
    assert sorted(map(str, box(spark, at).reports().drop("batch").collect())) == got and state(at) == files
    box(spark, at).batch(df, 2)  # the same files as a new batch: all were seen
    assert box(spark, at).reports().count() == 7 and state(at) == files
    one = tmp_path / "one"
    box(spark, one).start(str(tmp_path / "in/*"), str(one / "log")).awaitTermination()
    strip = lambda rows: [r.replace("/one/", "/two/") for r in rows]
    assert strip(sorted(map(str, box(spark, one).reports().drop("batch").collect()))) == got and state(one) == files
    assert {r.status: r.n_files for r in box(spark, at).counts().collect()} == {"ok": 5, "skipped": 1, "error": 1}


def test_batch_stopped_in_between(spark, tmp_path, monkeypatch):
    """Stopped after the reports and before the copies, and after the copies: the batch run again ends as if nothing was."""
    put(tmp_path / "in", "1/a.docx", "1/c.jpg")
    df = spark.read.format("binaryFile").load(str(tmp_path / "in/1")).select("path", "content")
    real = dropbox.copies.write
    for when in ("before", "after"):
        def stop(*args, when=when):
            if when == "after":
                real(*args)
            raise RuntimeError("stopped")

        monkeypatch.setattr(dropbox.copies, "write", stop)
        with pytest.raises(RuntimeError):
            box(spark, tmp_path).batch(df, 0)
    monkeypatch.setattr(dropbox.copies, "write", real)
    box(spark, tmp_path).batch(df, 0)
    assert set(state(tmp_path)) == {"a_clean.docx", "c_clean.jpg"} and box(spark, tmp_path).reports().count() == 2


def test_stream_is_planned_once(spark, tmp_path, monkeypatch):
    """Three batches of one cleaning plan; each name in all three folders."""
    put(tmp_path / "in", *(f"{k}/{n}" for k in range(3) for n in ("c.jpg", "d.svg", "e.txt", "f.png")))
    plans, real = [], dropbox.clean.clean_files
    monkeypatch.setattr(dropbox.clean, "clean_files", lambda *args: plans.append(1) or real(*args))
    box(spark, tmp_path).start(str(tmp_path / "in/*"), str(tmp_path / "log"), per_trigger=4).awaitTermination()
    told = box(spark, tmp_path).reports()
    assert len(plans) == 1
    assert told.select("batch").distinct().count() == 3 and told.filter("status = 'ok'").select("dst").distinct().count() == told.filter("status = 'ok'").count()
    assert {"c_clean.jpg", "c_clean_1.jpg", "c_clean_2.jpg", "d_clean_2.svg"} <= set(state(tmp_path))


def test_names_alone(spark):
    """The short way gives what the long one gives, and nothing where a name is taken or comes twice."""
    from metascrub.operators import reports

    rows = [("in/a.jpg", "ok"), ("in/b.tar.gz", "clean"), ("x/.c", "ok"), ("y/a.jpg", "error")]
    files = spark.createDataFrame(rows, "path string, status string")
    taken = spark.createDataFrame([("out/a_clean_1.jpg",), ("out/z",)], "path string")
    got = {tuple(r) for r in reports.name_alone(files, taken, "_clean", "out").select("path", "dst").collect()}
    assert got == {tuple(r) for r in reports.name_outputs(files, taken, out_dir="out").select("path", "dst").collect()}
    assert reports.name_alone(files, taken.unionByName(spark.createDataFrame([("out/a_clean.jpg",)], "path string")), "_clean", "out") is None
    assert reports.name_alone(files.unionByName(spark.createDataFrame([("z/a.jpg", "ok")], "path string, status string")), taken, "_clean", "out") is None


def test_batch_with_repeated_rows(spark, tmp_path):
    """A path that comes twice in a batch is one file."""
    put(tmp_path / "in", "1/c.jpg", "1/d.svg")
    df = spark.read.format("binaryFile").load(str(tmp_path / "in/1")).select("path", "content")
    box(spark, tmp_path).batch(df.unionAll(df), 0)
    assert set(state(tmp_path)) == {"c_clean.jpg", "d_clean.svg"} and box(spark, tmp_path).reports().count() == 2


def test_ledger(spark, tmp_path):
    """Many batches: none twice, also when batches are run again; compacted, the folders stay few."""
    r = random.Random(2)
    ledger, seen = dropbox.Ledger(spark, str(tmp_path / "seen")), set()
    for b in range(12):
        paths = [f"p{r.randrange(60)}" for _ in range(15)] + [None]
        df = spark.createDataFrame([(p, 1) for p in paths], "path string, x int")
        want = set(filter(None, paths)) - seen
        for _ in range(2):
            assert sorted(x.path for x in ledger.fresh(df, b).collect()) == sorted(want)
        seen |= want
        if b % 4 == 3:
            ledger.compact(b)
    assert sorted(x.path for x in ledger.all().collect()) == sorted(seen) and len(os.listdir(tmp_path / "seen")) <= 6


def events(seed, n=40):
    r = random.Random(seed)
    rows = []
    for p in range(n):
        at = 0
        rows.append((f"p{p}", at, "add", None, None))
        for attempt in range(r.randint(0, 3)):
            at += r.randint(1, 3)
            rows.append((f"p{p}", at, "start", attempt, None))
            if r.random() < 0.2:
                rows.append((f"p{p}", at + 1, r.choice(dropbox.COMMANDS), None, None))  # a command to a working item
            if r.random() < 0.8:
                at += r.randint(1, 3)
                rows.append((f"p{p}", at, "finish", attempt, r.choice(["ok", "error"])))
            for _ in range(r.randint(0, 2)):
                at += 1
                rows.append((f"p{p}", at, r.choice(dropbox.COMMANDS), None, None))
    return rows


def test_queue_by_hand(spark):
    rows = [("a", 0, "add", None, None), ("b", 1, "start", 0, None), ("b", 2, "retry", None, None), ("c", 1, "start", 0, None), ("c", 3, "finish", 0, "ok"), ("c", 2, "retry", None, None), ("d", 1, "finish", 1, "error"), ("d", 2, "clear", None, None), ("d", 3, "reclean", None, None), ("e", 1, "finish", 0, "ok"), ("e", 2, "clear", None, None)]
    got = {r.path: (r.state, r.attempt, r.status) for r in dropbox.queue(spark.createDataFrame(rows, dropbox.EVENTS)).collect()}
    assert got == {"a": ("pending", 0, None), "b": ("working", 0, None), "c": ("done", 0, "ok"), "d": ("pending", 2, "error"), "e": ("cleared", 0, "ok")}


def test_requeue(spark, tmp_path):
    """A log out of order, with repeats, over several batches and a restart gives the queue of the batch form."""
    rows = events(1)
    want = sorted(map(tuple, dropbox.queue(spark.createDataFrame(rows, dropbox.EVENTS)).collect()))
    told = rows + random.Random(3).sample(rows, len(rows) // 3)
    random.Random(4).shuffle(told)
    for k in range(3):
        spark.createDataFrame(told[k::3], dropbox.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = dropbox.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], dropbox.EVENTS).schema, "parquet", 1)
        dropbox.start_requeue(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(map(tuple, dropbox.queued(spark, str(tmp_path / "out")).collect())) == want
