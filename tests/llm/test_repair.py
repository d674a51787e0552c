"""Repair of conversations against a brute-force search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest

from metascrub.llm import queries, repair

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
BLANK = "[^\x20\x09-\x0d]"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
    return out


def cheapest(turns):
    """The least cost, then audit, of all ways; turns are (initial, must go, truncated)."""
    goes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if inserts < 3:
            for to in goes[state].keys() - {"s"}:
                c, audit, made = best(i, to, inserts + 1)
                ways.append((c + 3, "I" + audit, (to, *made)))
        if i < len(turns):
            initial, must, truncated = turns[i]
            c, audit, made = best(i + 1, state, 0)
            ways.append((c + 4, "D" + audit, made))
            if not must:
                for to in goes[state]:
                    c, audit, made = best(i + 1, to, 0)
                    if to == initial:
                        ways.append((c + 3 * truncated, "K" + audit, (to, *made)))
                    elif to != "s":
                        ways.append((c + 3 + 3 * truncated, "R" + audit, (to, *made)))
        return min(ways, default=(10**9, "", ()))

    sys.setrecursionlimit(10_000)
    return best(0, "", 0)


def brute(rows, every):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in every}
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        sha = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
        convs[conv].append((turn is not None, turn or 0, role, sha, text, turn))
    for conv, own in convs.items():
        own.sort(key=lambda x: x[:4])
        seen, kinds, turns = set(), defaultdict(int), []
        for _, _, role, _, text, _ in own:
            last = re.findall(BLANK, text)[-1:]
            kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            kinds[kind] += 1
            turns.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        cost, audit, made = cheapest(tuple(turns))
        full, left, new = [], list(own), list(made)
        for edit in audit:
            row = left.pop(0) if edit != "I" else None
            if edit != "D":
                letter = new.pop(0)
                role = row[2] if edit == "K" else {"u": "user", "a": "assistant"}[letter]
                full.append(f"{role}:{row[4] if row else ''}")
        numbers = [x[5] for x in own if x[5] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        assert re.fullmatch("(s?(ua)+)?", "".join(made))
        out[conv] = (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(full).encode()).hexdigest())
    return out


def told(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_tables():
    """Every block of the tables against single steps; the traces against brute force."""
    t = repair.tables()
    assert 4 < len(t.vectors) < 200 and len(set(t.vectors)) == len(t.vectors) and all(min(v) == 0 for v in t.vectors)
    for v in range(len(t.vectors)):
        for number in range(0, repair.SYMBOLS**repair.BLOCK, 7):
            digits = [number // repair.SYMBOLS**k % repair.SYMBOLS for k in range(repair.BLOCK)]  # the last turn first
            want, more = v, 0
            for d in digits:
                want, more = t.one[want, d], more + t.one_more[want, d]
            assert (t.block[v, number], t.block_more[v, number]) == (want, more)
    r = random.Random(3)
    for _ in range(1500):
        symbols = np.array([r.randrange(9) for _ in range(r.randint(0, 11))], np.uint8)
        turns = tuple(("suax"[s // 2] if s < 8 else "u", s == 8, bool(s < 8 and s % 2)) for s in symbols.tolist())
        done, state = repair.traced(symbols, 0, repair.START)
        last = repair.finish(state)
        cost, audit, made = cheapest(turns)
        assert ("".join(e for e, _ in done) + last[0], ("".join(m for _, m in done) + last[1]).replace("-", "")) == (audit, "".join(made))
        _, vector, more = repair.ahead(symbols, 0)
        assert more + t.vectors[vector][repair.START] == cost


def chats(seed, n=80):
    r = random.Random(seed)
    texts = ["Yes.", "No", "", None, " \t", "Why?\x0b ", "é!", "ok. so"]
    return [(c, r.choice([t, t, t + 1, None, 3 * t]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(texts) if r.random() < 0.6 else f"T{r.random()}{r.choice('.!?x')}") for c in range(n) for t in range(r.randint(1, 12))]


@pytest.mark.parametrize("split", [False, True])
def test_repair(spark, split):
    """Also where conversations are dealt over several parts."""
    rows = chats(split) + [(None, t, "user", f"{t}.") for t in range(9)] + [(7777, t % 90, "user" if t % 3 else "assistant", f"{t % 97}.") for t in range(160)]
    df = spark.createDataFrame(rows, ROWS)
    if split:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        damage = repair.damage(df)
        assert sorted(map(str, (tuple(r) for r in damage.collect()))) == sorted(map(str, damaged(rows)))
        assert told(repair.reports(damage)) == brute(damaged(rows), [])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parts_are_chained(spark):
    """One conversation over many parts, and what is between its parts, by hand."""
    r = random.Random(5)
    symbols = np.array([r.randrange(9) for _ in range(500)], np.uint8)
    whole, state = repair.traced(symbols, 0, repair.START)
    for cuts in ([0, 500], [0, 1, 2, 499, 500], list(range(0, 501, 7)) + [500]):
        pieces = [symbols[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
        vector, behind = 0, []
        for p in pieces[::-1]:
            behind.append(vector)
            vector = int(repair.ahead(p, vector)[1])
        now, done = repair.START, []
        for p, v in zip(pieces, behind[::-1]):
            more, now = repair.traced(p, v, now)
            done += more
        assert done == whole and now == state


def test_repaired_rows(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "Still?"), (1, 4, "assistant", "Yes."), (2, 1, "user", " ")]
    got = repair.repaired(spark.createDataFrame(rows, ROWS))
    order = sorted(got.collect(), key=lambda x: (x.conv_id, x.part, x.turn, x.old_role, x.turn_hash, x.place))
    audit = brute([tuple(x) for x in rows], [])[1][6]
    assert "".join(x.edit for x in order) == audit.replace("D", "") and {x.conv_id for x in order} == {1}
    assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in order))


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (2, None, None, None), (None, None, "user", "x"), (3, 1, "user", "y" * 2_000_000 + "."), (4, 9, "", ""), (4, -9, "assistant", "\r")]
    df = spark.createDataFrame([(*r, 1, "x", b"") for r in rows], ROWS + ", part int, edits string, turn_hash binary")
    assert told(repair.reports(repair.damage(df))) == brute(damaged(rows), [])
    assert told(repair.reports(df)) == brute([(c, t, " " if x is None else x, " " if y is None else y) for c, t, x, y in rows], [])
    assert not repair.reports(df.limit(0)).count() and not repair.repaired(df.limit(0)).count()


def test_query(spark):
    """The registered query on all conversations."""
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert told(queries.QUERIES["op11_structure_repair"](spark, SF)) == brute(damaged(rows), {r[0] for r in rows})
