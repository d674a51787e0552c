"""Personal data: plain spans against the patterns themselves, disguises by exact spans of the source."""

import hashlib
import random
import re

import duckdb
import pytest

from metascrub.llm import pii, queries

SF = "/root/testdata/sf0.001"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    """The contract, word by word."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), k == 2 and 12 <= len(digits) <= 19 and luhn(digits), k == 3 and 9 <= len(digits) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_plain_spans(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("a@.1+- (2345)%é\n0@..") for _ in range(r.randint(0, 70))) for _ in range(8000)]
    base, every = pii.spans(texts)
    assert base == [plain(t) for t in texts] and sum(map(len, base)) > 300
    assert all(set(b) <= set(e) for b, e in zip(base, every))


#: Kind, and the disguised text between guillemets.
DISGUISED = [
    ("email", "write «john (at) example (dot) com» now"), ("email", "«john dot smith at example dot co dot uk»!"), ("email", "«jоhn@exаmple.com»"), ("email", "é «john＠example．com»"), ("email", "«jo\u200bhn@ex\u00adample.com»"),
    ("email", "«john&#64;example&period;com»"), ("email", "«jean arroba exemple punto fr»"), ("email", "«john @ example dot com»"), ("email", "x «jo.hn[at]example.com», y"), ("email", "«max {ät} beispiel [punkt] de»"),
    ("phone", "call «plus four four two oh seven nine four six zero nine five eight»"), ("phone", "«+49 null acht null zwei drei vier fünf sechs sieben»"), ("phone", "«plus double four two oh seven nine four six zero nine five eight»"), ("phone", "«＋１ ６１４ ５５５ ６７２７»"),
    ("card", "«４１１１ １１１１ １１１１ １１１１»"), ("card", "«4111–1111–1111–1111»"), ("card", "«4111 11l1 1111 1I11»"), ("card", "«cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno»"),
    ("ip", "from «192 dot 168 dot 1 dot 1»."), ("ip", "«192[.]168[.]0[.]12»"), ("ip", "«one nine two dot one six eight dot one dot one»"), ("ip", "«10․20․30․40»"),
]


@pytest.mark.parametrize("kind,text", DISGUISED)
def test_disguises(kind, text):
    start, end = text.index("«"), text.index("»") - 1
    [base], [every] = pii.spans([text.replace("«", "").replace("»", "")])
    assert (start, pii.KINDS.index(kind), end) in every and (start, pii.KINDS.index(kind), end) not in base


def test_prose_stays():
    texts = [
        "Look at this. Then go at noon, dot the i.", "meet me @ example.com", "one two three four, five six", "Deux trois quatre euros — un deux.", "+ 10 – 20 %", "plus one two three", "3 point 5 and 4 dot 5", "a (at) b", "version 1.2.3 – 4",
        "ten – eleven\u00a0000\u00a0000", "he was at dinner dot dot dot", "a@b@c", "②③", "x at y.com and z",
    ]
    base, every = pii.spans(texts)
    assert base == every == [[] for _ in texts]
    [b], [e] = pii.spans(["+1 (614) 555-6727 – 20 people, un 4111111111111111"])
    assert b == e and len(b) == 2


def test_long_runs():
    """Runs that each pattern could try at every character take time in proportion."""
    texts = [x * (1_000_000 // len(x)) for x in ("1", "a", "@a", "1.1.", "+1 ", "one ", "a dot ", "(at)", " ", "–")] + ["x" * 2_000_000 + "@e.com " + "y" * 2_000_000 + " (at) f (dot) org"]
    base, every = pii.spans(texts)
    assert base[-1] == [(0, 0, 2_000_006)] and every[-1] == [(0, 0, 2_000_006), (2_000_007, 0, 4_000_024)]


def test_odd_rows(odd, spark):
    got = pii.find(odd)
    assert got.columns == ["doc_id", "base", "spans"] and got.count() == odd.count() and not got.filter("size(spans) > 0").count()
    assert pii.find(odd.limit(0)).count() == 0
    assert sorted(map(str, pii.redact(odd).collect())) == sorted(map(str, odd.collect()))
    rows = [(1, "a@b.cc and jоe (at) b (dot) cc +1 2345678901", None), (1, "a@b.cc and jоe (at) b (dot) cc +1 2345678901", None), (None, "1.2.3.4", "k"), (2, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert [r.text for r in pii.redact(df.coalesce(1)).collect()] == ["<email> and <email> <phone>"] * 2 + ["<ip>", None]
    assert sorted(len(r.spans) for r in pii.find(df).collect()) == [0, 1, 3, 3]


def test_query(spark):
    """The registered query on all documents against the contract."""
    got = {r.doc_id: r for r in queries.QUERIES["op13_pii"](spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        want = plain(text or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in want) for n in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(got[i].spans.split(","))
