"""Operators 1, 4, 6 and 9 as registered, over whole tables."""

import re
import zlib
from collections import Counter

import duckdb
import pytest
from test_text_ops import brute_tiles

from metascrub.llm import queries

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs():
    return {i: (t, lang) for i, t, lang in duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()}


def test_op1(spark, docs):
    """All base columns by the contract; the labelled documents fall on their sides."""
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality_rules"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, (text, _) in docs.items():
        text = text or ""
        w = re.findall(WORD, text)
        c = Counter(zip(w, w[1:], w[2:]))
        repeated = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (r.base_failed and r.kept)
    labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    right = [got[i].kept == bool(q) for i, q in labels if i in got and not got[i].base_failed]
    assert sum(right) >= 0.9 * len(right)


def test_op4(spark, docs):
    """Every secret whose format tells it is found; what is found stands in its text and holds a letter."""
    got = [(r.doc_id, r.value) for r in queries.QUERIES["op4_secret_scan"](spark, SF).collect()]
    told = {(i, m) for i, (t, _) in docs.items() for m in re.findall(r"(?<![A-Za-z0-9_+/.\-])AKIA[A-Z0-9]{16}(?![A-Za-z0-9_+/\-])", t or "")}
    assert told <= set(got) and all(v in docs[i][0] and re.search("[A-Za-z]", v) for i, v in got)


def test_op6(spark, docs):
    """Held-out documents get their language; a text without a letter gets none."""
    got = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, SF).collect()}
    assert set(got) == set(docs) and all(0 <= r.score <= 1 for r in got.values())
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out} == held
    assert all((got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, (t, _) in docs.items())
    right = [got[i].lang_pred == docs[i][1] for i in held if docs[i][1] and got[i].lang_pred != "und"]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)


def test_op9(spark, docs):
    """Every leak by tiling as published; words are runs of letters and digits in lower case."""
    def words(t):
        return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t or "")]

    items = {i: words(t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()}
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = []
    for d, (text, _) in docs.items():
        w = words(text)
        g = grams(w, 5)
        for k, item in items.items():
            if len(item) >= 5 and g & grams(item, 5):
                near = [x for x in range(len(w)) if any(tuple(w[y : y + 5]) in grams(item, 5) for y in range(max(0, x - 4), x + 1))]
                part = w[max(0, near[0] - 1) : near[-1] + 2]  # the rest shares no five words
                got = brute_tiles(part, item, 5)
                if 2 * sum(t[2] for t in got) >= len(item):
                    want.append((d, k, sum(t[2] for t in got)))
    found = [tuple(r)[:2] + (r[3],) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()]
    assert Counter(found) == Counter(want) and want
