"""The trie of rebuilt conversations against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from metascrub.llm import ordered, queries, trie

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract on lists of turns and sets of members."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role, sha, text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].add(c)
            if d:
                children[tuple(full[: d - 1])].add(tuple(full[:d]))
        ends[tuple(full)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()
    )


def told(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def chats(seed, n=150):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * r.choice([1, 1, 7]) - 20
        for turn in range(r.randint(1, 9)):
            rows.append((c, r.choice([turn, turn, None, turn // 2]), r.choice(["user", "assistant", None, ""]), r.choice(["a", "bé", "", None, "cc c"])))
    return rows


@pytest.mark.parametrize("most,band", [(1024, 1024), (5, 1024), (5, 2), (1, 1), (1000, 1)])
def test_trie(spark, most, band):
    """However the nodes are dealt."""
    rows = chats(most + band)
    assert told(trie.trie(spark.createDataFrame(rows, ROWS), most, band)) == brute(rows)


def test_long_conversations(spark):
    """Long equal ways, and long conversations that are dealt over several parts."""
    rows = [(c, t, "user", f"t{t % 50}" if t < 60 else f"x{c}") for c in (100, 101, 102, 103) for t in range(63)] + [(0, 5, "user", "hot")] * 90 + [(7, t, "u", "only") for t in range(150)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, ROWS)
        assert len(ordered.shared(ordered.dealt(df, ["conv_id", "turn", "role", "text"], "test"), "conv_id").filter("conv_id in (0, 7)").collect()) >= 1
        assert told(trie.trie(df, 2, 16)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 1, "user", "x"), (3, 1, "user", "y" * 2_000_000), (-5, 2, "", ""), (203, 1, "user", "y" * 2_000_000)]
    df = spark.createDataFrame([(*r, 1, "x", b"") for r in rows], ROWS + ", depth int, parent string, digest binary")
    assert told(trie.trie(df)) == brute(rows)
    assert trie.trie(df.limit(0)).count() == 0 and trie.trie(df.filter("conv_id is null")).count() == 0


def test_batches(spark):
    """A conversation that goes on over Arrow batches."""
    rows = [(100, t, "user", f"{t}") for t in range(40)] + [(101, t, "user", f"{t}") for t in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert told(trie.trie(spark.createDataFrame(rows, ROWS))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slots():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    slots = trie.Slots(keys)
    assert sorted(slots(keys)) == list(range(5000)) and (slots(keys + np.uint64(1)) == -1).all()
    assert not len(trie.Slots(keys[:0])(keys[:0]))
    with pytest.raises(ValueError):
        trie.Slots(np.concatenate([keys, keys[:1]]))


def test_shared_digest(spark):
    """Two prefixes of one digest end the job."""
    rows = spark.createDataFrame([(1, 1, b"x" * 16, b"p" * 16, b"t" * 32, 1, True), (2, 1, b"x" * 16, b"p" * 16, b"u" * 32, 1, True)], "conv_id long, depth long, digest binary, parent binary, turn binary, chars long, last boolean")
    with pytest.raises(Exception, match="share a digest"):
        trie.nodes(rows).collect()


def test_query(spark):
    """The registered query on all conversations."""
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert told(queries.QUERIES["op12_prefix_trie"](spark, SF)) == brute(rows)
