"""WARC round trips and damage, chat windows, and the pipeline."""

import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from metascrub.llm import chat, queries, warc

SF = "/root/testdata/sf0.001"


PAGES = "page_id long, url string, html string, digest string, size int"


def by_page(rows):
    return {int(r.record_id.split(":")[2]): r for r in rows}


def test_warc_round_trip(spark):
    big = "x" * 1500
    pages = [(1, "u", big), (2, "u\n v", big), (3, None, None), (4, "w", "é"), (5, "w", "é"), (6, "z", big), (7, "q", "WARC/1.1\r\n\r\n"), (8, "long", "ab é " * 400_000)]
    pages = spark.createDataFrame([(*p, "own", 1) for p in pages], PAGES)
    got = warc.read(warc.archives(warc.records(pages)), payloads=True).collect()
    assert all(r.kind == "record" for r in got) and len({r.record_id for r in got}) == 8
    got = by_page(got)
    assert [got[i].record_type for i in range(1, 9)] == ["revisit", "revisit", "response", "response", "response", "response", "response", "response"]
    assert got[1].refers_to == got[6].record_id and got[1].payload_bytes == 1500 and bytes(got[4].payload) == "é".encode()
    assert bytes(got[8].payload) == ("ab é " * 400_000).encode()
    assert warc.read(warc.archives(warc.records(pages.limit(0)))).count() == 0


def test_warc_odd_rows(spark):
    """Null and repeated page ids lose no row, and different rows have different record ids."""
    big, other = "x" * 1500, "y" * 1500
    pages = [(None, "a", big), (None, "b", big), (1, "a", big), (1, "b", big), (None, "c", other), (None, "d", other), (2, "e", None), (2, "e", None), (0, "a", big)]
    got = warc.read(warc.archives(warc.records(spark.createDataFrame([(*p, None, 0) for p in pages], PAGES).repartition(3)))).collect()
    assert len(got) == len(pages) and all(r.kind == "record" for r in got) and len({r.record_id for r in got}) == len(pages) - 1
    kinds = Counter((r.record_id.split(":")[2], r.record_type) for r in got)
    assert kinds == Counter({("", "revisit"): 2, ("1", "response"): 2, ("", "response"): 2, ("2", "response"): 2, ("0", "revisit"): 1})
    ids = {r.record_id for r in got}
    assert all(r.refers_to in ids and ":1:" in r.refers_to for r in got if r.record_type == "revisit")


def test_warc_damage_in_proportion():
    """Damage all over a big archive is passed in proportion to its size."""
    import time

    took = []
    for n in (2000, 8000):
        data = bytearray(b"".join(record(b"p%d" % i) for i in range(n)))
        for at in range(9, len(data), 500):
            data[at] ^= 0xFF
        start = time.time()
        saved = sum(r is not None for _, _, r, _ in warc.salvage(bytes(data)))
        took.append(time.time() - start)
        assert saved > n / 3
    assert took[1] < 12 * took[0] + 1


def record(payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(payload).hexdigest().encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_salvage(zipped):
    pieces = [gzip.compress(record(b"p%d" % i)) if zipped else record(b"p%d" % i) for i in range(6)]
    whole = b"".join(pieces)
    for at in range(len(pieces[0]), len(pieces[0]) * 2, 7):  # damage anywhere in the second record
        data = bytearray(whole)
        data[at] ^= 0x5A
        got = list(warc.salvage(bytes(data)))
        assert [r["payload"] for _, _, r, _ in got if r][-4:] == [b"p2", b"p3", b"p4", b"p5"]
        ends = [0, *(stop for _, stop, _, _ in got)]
        assert ends[-1] == len(data) and all(s in ends for s, _, _, _ in got)
    got = list(warc.salvage(b"junk" + whole[: -len(pieces[5]) // 2]))
    assert [r["payload"] for _, _, r, _ in got if r] == [b"p%d" % i for i in range(5)] and got[0][2] is None and got[-1][2] is None
    assert list(warc.salvage(b"")) == []


def test_warc_salvage_in_members():
    """Records before and after a fault inside a member, base32 and unknown digests, and a very long header are kept."""
    import base64
    import random

    noise = lambda k: bytes(random.Random(k).choices(range(256), k=3000))
    told = lambda data: [r["payload"] for _, _, r, _ in warc.salvage(data) if r]
    pieces = [record(noise(k)) for k in range(40)]
    stream = gzip.compress(b"".join(pieces))
    assert told(stream[: len(stream) // 2]) == [noise(k) for k in range(19)]
    bad = bytearray(stream)
    bad[len(bad) // 2] ^= 0x5A
    got = told(bytes(bad))
    assert len(got) >= 38 and set(got) <= {noise(k) for k in range(40)}
    broken = pieces[:10] + [pieces[10].replace(b"Content-Length: ", b"Content-Length: 9")] + pieces[11:]
    member = gzip.compress(b"".join(broken))
    got = list(warc.salvage(member))
    assert [r["payload"] for _, _, r, _ in got if r] == [noise(k) for k in range(40) if k != 10] and got[-1][:3] == (0, len(member), None)
    for digest in (b"sha1:" + base64.b32encode(hashlib.sha1(b"p").digest()), b"sha256:" + hashlib.sha256(b"p").hexdigest().encode(), b"crc9:1"):
        one = record(b"p").replace(b"sha1:" + hashlib.sha1(b"p").hexdigest().encode(), digest)
        assert told(one) == told(gzip.compress(one)) == [b"p"]
    assert told(record(b"p").replace(hashlib.sha1(b"p").hexdigest().encode(), base64.b32encode(hashlib.sha1(b"q").digest()))) == []
    assert told(gzip.compress(record(b"p").replace(b"WARC-Type", b"WARC-Target-URI: " + b"u" * (2 << 20) + b"\r\nWARC-Type"))) == [b"p"]


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", "yo " * 30), (1, 3, "user", "and?\\n <|im_end|>\n"), (1, 4, "assistant", "</s>\\e" * 9), (1, 5, None, None), (2, 0, "assistant", ""), (3, 0, "user\n", "<s><|im_start|>x"), (3, 0, "assistant", "w " * 200)]
    rows = [*rows, *((4, i, "assistant" if i % 2 else "user", "t " * (i % 5)) for i in range(60))]
    got = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60, history=20)
    back, said = {}, {}
    for r in sorted(chat.read_back(got).collect(), key=lambda r: (r.conv_id, r.window)):
        back.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        said.setdefault(r.conv_id, []).extend(r.targets)
    for c in (1, 2, 3, 4):
        turns = [((x[2] or ""), (x[3] or "")) for x in sorted((r for r in rows if r[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert back[c] == turns
        assert said[c] == [t for role, t in turns if role == "assistant"]
    windows = got.collect()
    assert all(w.n_tokens <= 60 or w.over_budget for w in windows) and any(w.lead for w in windows)
    assert all(w.formatted.startswith("<|im_start|>system\nbe kind") for w in windows if w.conv_id == 1)
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_chat(rows):
    by, out = {}, {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for *_, role, x in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_query(spark):
    """op5 as registered against brute force over the whole table."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    got = queries.QUERIES["op5_chat_formatting"](spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute_chat(rows)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_chat_odd_rows(spark, monkeypatch):
    """A null conv_id, null and equal turns, repeated rows, clashing columns, a very long text, and conversations of many blocks."""
    import random

    monkeypatch.setattr(chat, "RANGE", 4)
    monkeypatch.setattr(chat, "BLOCK", 2)
    r = random.Random(3)
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (1, None, "assistant", "null turn"), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y" * 300_000), (2, 5, None, None)]
    rows += [(3, i, "system" if i == 0 else "assistant" if i % 2 else "user", "k" if i == 0 else "w " * r.randrange(6)) for i in range(300)]
    rows += [(4, -i, "assistant", "v " * (200 if i % 7 == 0 else 3)) for i in range(100)] + [(5, 0, "system", "only")]
    docs = spark.createDataFrame([(*x, "p", 1, 2) for x in rows], "conv_id long, turn long, role string, text string, piece string, at int, block int").repartition(4)
    out = chat.windows(docs, budget=70, history=25).collect()
    back, said = {}, {}
    for w in sorted(chat.read_back(spark.createDataFrame(out, chat.windows(docs).schema)).collect(), key=lambda w: (w.conv_id or 0, w.window)):
        back.setdefault(w.conv_id, []).extend((t.role, t.text) for t in w.turns)
        said[w.conv_id] = said.get(w.conv_id, "") + "".join(w.targets)
    for c, turns in back.items():
        own = sorted((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c)
        assert turns == [x[2:] for x in own] and said[c] == "".join(x for *_, role, x in own if role == "assistant")
    assert set(back) == {None, 1, 2, 3, 4, 5}
    long = [w for w in out if w.conv_id == 3]
    assert len(long) > 30 and all(w.formatted.startswith("<|im_start|>system") for w in long) and sum(w.lead > 1 for w in long) > len(long) / 2
    assert all(w.n_tokens <= 70 or w.over_budget for w in out)


def same(spark, name, sql):
    import os

    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    db.register("got", queries.QUERIES[name](spark, SF).toArrow())
    db.sql(f"create temp table want as {sql}")
    listed = ", ".join(sorted(c[0] for c in db.sql("describe got").fetchall()))
    return not db.sql(f"(select {listed} from want except all select {listed} from got) union all (select {listed} from got except all select {listed} from want)").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert same(spark, name, queries.ORACLES[name])


def test_queries_on_texts(spark):
    """op3, op7, op8 as registered against brute force over the whole table."""
    from test_text_ops import brute_links, brute_substring, brute_suffix

    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    run = lambda name: {r.doc_id: tuple(r)[1:] for r in queries.QUERIES[name](spark, SF).collect()}
    assert run("op8_substring_dedup") == {k: v for k, v in brute_substring(rows).items()}
    assert run("op7_suffix_array_dedup") == brute_suffix(rows)
    got = run("op3_ngram_jaccard_join")
    sizes = {i: v[:2] for i, v in brute_links([(i, t) for i, t in rows], 3, 90).items()}
    assert {i: v[:2] for i, v in got.items()} == sizes


def test_pipeline_language(spark):
    """Junk with a few letters and texts in a language that was never learned go; texts of the learned ones stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    away = [(-1, "#$% a ^&* (@! b {} ~~ %% ## x && ** ;;"), (-2, "minä olen syönyt kalaa joen rannalla koska sää oli kaunis eikä kukaan tullut häiritsemään meitä koko pitkän päivän aikana"), (-3, "nie wiem jak to zrobić ale przecież wszyscy mówią że trzeba szybko wrócić do domu przed zmierzchem ponieważ później będzie ciemno")]
    away = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in away], docs.schema)
    got = [r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(away), SF).collect()]
    assert not [i for i in got if i < 0] and len(got) >= 0.98 * docs.count()
    most = docs.filter("lang <> 'es'").unionByName(docs.filter("lang = 'es'").withColumn("lang", F.lit(None).cast("string")))
    got = Counter(r.doc_id for r in corpus_pipeline.language(spark, most, SF).collect())
    unseen = [r.doc_id for r in docs.filter("lang = 'es'").collect()]
    assert sum(got[i] for i in unseen) <= 0.1 * len(unseen) and sum(got.values()) >= 0.98 * (docs.count() - len(unseen))


def test_pipeline_rows(spark):
    """Rows without a doc_id and rows that share one are judged one by one."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    said = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    near = said(1, 60)
    rows = [(None, said(0)), (None, said(0)), (None, said(2)), (None, None), (5, near), (7, near + " more"), (7, said(3)), (7, said(3)), (7, said(4)), (9, said(4) + ""), (9, None), (9, "")]
    rows = [(i, t, None, "s", 1) for i, t in rows] + [(11, "", "x", None, 1), (11, "x", "", None, 1), (11, None, "x", "", 1), (12, said(5), "en", "s", 1), (12, said(5), "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    want = [(None, said(0))] * 2 + [(None, said(2)), (None, None), (5, near), (7, said(3)), (7, said(4)), (9, None), (9, ""), (11, ""), (11, "x"), (11, None), (12, said(5))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)

    import random

    r = random.Random(6)
    hexed = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(80)]
    texts = [f'words token = "{s}" words' if i % 2 else f"commit {s} was made" for i, s in enumerate(hexed)]
    docs = spark.createDataFrame([((None, 3)[i % 4 < 2], t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, f"commit {hexed[1]} was made", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars int")
    clean = Counter(x.text for x in corpus_pipeline.secrets(spark, docs, SF).collect())
    assert clean['words token = "[REDACTED]" words'] == 40 and all(clean[t] == 1 for t in texts[::2]) and clean[f"commit {hexed[1]} was made"] == 1


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        sizes.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == sizes[-1]
    assert whole.agg(F.countDistinct("doc_id")).first()[0] <= sizes[4]
