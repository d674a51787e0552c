"""Personal data in texts, also in disguise, with spans in the text as it is.

Three transducers follow each other: characters that look like others (homoglyphs, forms of other widths, invisible ones,
entities), digits that are spelled out, and at signs and dots that are written as words or in brackets. Each is a list of
rewrites (start, end, output) of its input, kept as a map of segments, so that a span of the last text leads back through
all three to code points of the source. The same four detectors read the source (base spans) and the normalised text; a
span found only there is added. A text without any rewrite is read once. Map-only: no row is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

#: Letters of other scripts by the Latin letters they look like.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "κк", "l": "ӏǀ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ", ".": "。｡٫", "+": "➕",
}
#: Digits as words of English, French, German and Spanish, from zero.
DIGITS = ["zero oh zéro null cero", "one un eins uno", "two deux zwei dos", "three trois drei tres", "four quatre vier cuatro", "five cinq fünf fuenf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve"]
#: Words for the at sign, the dot and the plus sign, and how often a word before a digit repeats it.
AT, DOT, PLUS, TIMES = "at ät arroba", "dot punto punkt point", "plus más mas", {"double": 2, "triple": 3}
#: Entities and escapes of the at sign, the dot and the plus sign.
ENTITIES = {"@": r"&#0*64;|&#[xX]0*40;|&commat;|%40", ".": r"&#0*46;|&#[xX]0*2[eE];|&period;", "+": r"&#0*43;|&#[xX]0*2[bB];|&plus;"}
USEFUL = re.compile(r"[A-Za-z0-9@.+() _%-]")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
GROUPED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PLUSSED = re.compile(r"\+[0-9][ ().0-9-]++")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def detect(text: str) -> list[Span]:
    """All spans of the four kinds, leftmost and apart within a kind; in time that grows with the text alone.

    Each pattern is found from what bounds it (the at sign, a whole chain of digits), as trying it at every character is
    quadratic in a long run."""
    found, end = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            end = m.end()
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, 1, at + size))
            at += size + 1
    for m in GROUPED.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub(r"[ -]", "", m.group())) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PLUSSED.finditer(text):
        shown = m.group().rstrip(" ().-")
        if len(shown) > 3 and 9 <= sum(c.isdigit() for c in shown) <= 15:
            found.append((m.start(), 3, m.start() + len(shown)))
    return sorted(found)


class Rewritten:
    """A text after rewrites (start, end, output), in order and apart, with the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.edits, out, at, new = edits, [], 0, 0
        self.new, self.old = [], []  # where segments begin; every second one is a rewrite
        for start, end, put in edits:
            self.new += [new, new + start - at]
            self.old += [at, start]
            out += [text[at:start], put]
            new, at = new + start - at + len(put), end
        self.new.append(new)
        self.old.append(at)
        self.text = "".join([*out, text[at:]]) if edits else text

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source of a span."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        a = self.old[i] if i % 2 else self.old[i] + start - self.new[i]
        return a, self.old[j + 1] if j % 2 else self.old[j] + end - self.new[j]

    def inside(self, start: int, end: int) -> list[str]:
        """Outputs of the rewrites in a span of the source."""
        i, j = bisect_right(self.edits, (start,)), bisect_right(self.edits, (end,))
        return [put for _, _, put in self.edits[i:j]]


def any_of(words: str) -> str:
    return "|".join(sorted(map(re.escape, words.split()), key=len, reverse=True))


@cache
def folds() -> tuple[dict[str, str], re.Pattern, str]:
    """What each character stands for: what it looks like, its compatibility form, its digit, a blank or hyphen for all
    of their kind, nothing for invisible ones; a pattern of all that are rewritten; and the same for Arrow."""
    table = {}
    for n in [*range(0x80, 0x3100), *range(0xA000, 0xAC00), *range(0xFB00, 0x20000)]:
        kind, c = unicodedata.category(chr(n)), chr(n)
        plain = unicodedata.normalize("NFKC", c)
        if kind == "Nd":
            table[c] = str(unicodedata.decimal(c))
        elif kind in ("Cf", "Pd", "Zs"):
            table[c] = {"Cf": "", "Pd": "-", "Zs": " "}[kind]
        elif len(plain) == 1 and USEFUL.fullmatch(plain):
            table[c] = plain
    table |= {c: latin for latin, alike in LOOKALIKES.items() for c in alike} | {"−": "-"}
    runs: list[list[int]] = []
    for n in sorted(map(ord, table)):
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    entities = "|".join(ENTITIES.values())
    found = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + f"]|{entities}")
    return table, found, "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + f"]|{entities}"


def characters(text: str) -> list[tuple[int, int, str]]:
    """Rewrites of single characters and entities."""
    table, pattern, _ = folds()
    return [(m.start(), m.end(), table[x] if (x := m.group()) in table else next(k for k, p in ENTITIES.items() if re.fullmatch(p, x))) for m in pattern.finditer(text)]


BETWEEN = re.compile(r"(?<=[0-9])[OolI]+(?=[0-9])")
WORD = "|".join(any_of(w) for w in DIGITS)
UNIT = rf"(?:(?:{'|'.join(TIMES)})[ -])?(?:{WORD})"
DOT_SEP = rf"[ \t]{{1,3}}(?:{any_of(DOT)})[ \t]{{1,3}}"
#: Two digit words or more, with blanks, hyphens, commas or a word for a dot between them, or one between digits.
SPELLED = re.compile(rf"(?:\b(?:{any_of(PLUS)})[ \t]{{1,3}})?\b{UNIT}(?:(?:[ \t,-]{{1,3}}|{DOT_SEP}){UNIT})+\b|(?<=[0-9][ -]){UNIT}(?=[ -][0-9])", re.I)
ITEM = re.compile(rf"(?P<plus>\b(?:{any_of(PLUS)})[ \t]{{1,3}})|(?P<dot>{DOT_SEP})|(?:(?P<times>{'|'.join(TIMES)})[ -])?(?P<word>{WORD})(?!\w)|[ \t,-]+", re.I)
VALUE = {w: str(n) for n, words in enumerate(DIGITS) for w in words.split()}


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Rewrites of runs of digit words, whose blanks go, and of letters that stand for digits between digits."""
    edits = [(m.start(), m.end(), "".join("0" if c in "Oo" else "1" for c in m.group())) for m in BETWEEN.finditer(text)]
    for run in SPELLED.finditer(text):
        for m in ITEM.finditer(text, run.start(), run.end()):
            word, times = m["word"], m["times"]
            put = VALUE[word.lower()] * TIMES.get((times or "").lower(), 1) if word else "+" if m["plus"] else "." if m["dot"] else ""
            edits.append((m.start(), m.end(), put))
    return sorted(edits)


OPEN, CLOSE = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
B_DOT = rf"{OPEN}(?:{any_of(DOT)}|\.){CLOSE}"
AT_SIGN = re.compile(rf"{OPEN}(?:{any_of(AT)}|@){CLOSE}|(?P<bare>[ \t]{{1,3}}(?:{any_of(AT)})[ \t]{{1,3}})|[ \t]{{0,3}}@[ \t]{{0,3}}", re.I)
LABEL = r"[A-Za-z0-9-]+"
SIGNED = re.compile(rf"{LABEL}(?:(?:\.|{B_DOT}){LABEL})+", re.I)  # dots as signs or in brackets
WORDED = re.compile(rf"{LABEL}(?:(?:{B_DOT}|{DOT_SEP})(?!(?:{any_of(DOT)})\b){LABEL})+(?!{DOT_SEP}(?:{any_of(DOT)})\b)", re.I)  # dots as words or in brackets; a dot word is no label
DISGUISED_DOT = re.compile(rf"{B_DOT}|{DOT_SEP}", re.I)
DOT_BEFORE = re.compile(rf"(?:{B_DOT}|{DOT_SEP})\Z", re.I)
DIGIT_DOT = re.compile(rf"(?<=[0-9])(?:{B_DOT}|{DOT_SEP})(?=[0-9])", re.I)


def signs(text: str) -> list[tuple[int, int, str]]:
    """Rewrites of at signs and dots. A bare word for the at sign counts only where words or brackets stand for the dots
    behind it, too, so that prose (``look at this.``) stays as it is; blanks around a sign count if there is a disguise."""
    edits = {m.span(): "." for m in DIGIT_DOT.finditer(text)}
    for m in AT_SIGN.finditer(text):
        if not m.start() or text[m.start() - 1] not in LOCAL:
            continue
        worded = WORDED.match(text, m.end())
        domain = worded if m["bare"] else max(filter(None, (worded, SIGNED.match(text, m.end()))), key=lambda x: x.end(), default=None)
        if not domain or m.group().strip() == "@" and m.group() != "@" and domain is not worded:
            continue
        if m.group() != "@":
            edits[m.span()] = "@"
        for d in DISGUISED_DOT.finditer(text, *domain.span()):
            edits[d.span()] = "."
        end = m.start()  # dots of the local part, back to its start
        while m.group() != "@" or domain is worded:
            while end and text[end - 1] in LOCAL:
                end -= 1
            d = DOT_BEFORE.search(text, max(0, end - 20), end)
            if not d or not d.start() or text[d.start() - 1] not in LOCAL:
                break
            edits[d.span()] = "."
            end = d.start()
    out: list[tuple[int, int, str]] = []
    for (a, b), put in sorted(edits.items()):
        if not out or a >= out[-1][1]:
            out.append((a, b, put))
    return out


#: For Arrow's linear matcher: every text that a detector or a transducer can find something in matches.
MAY_HOLD = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){11}|\+[0-9][ ().0-9-]"
MAY_SPELL = rf"(?i)\b(?:{WORD})(?:[ \t,-]{{1,3}}|{DOT_SEP}){UNIT}\b|[0-9][ -]{UNIT}[ -][0-9]|[0-9][oli]+[0-9]"
MAY_SIGN = rf"(?i){OPEN}(?:{any_of(AT)}|{any_of(DOT)}|@|\.){CLOSE}|{DOT_SEP}"


def may(texts: list[str], pattern: str) -> list[int]:
    """Which texts match."""
    return pc.indices_nonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), pattern)).to_pylist()


def disguised(texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """Spans of each source whose normalised text is an identifier and whose own text isn't read so. A span that only adds
    blanks or hyphens to a base span of its kind is none."""
    now, steps = list(texts), [[] for _ in texts]
    for rule, pattern in ((characters, folds()[2]), (spelled, MAY_SPELL), (signs, MAY_SIGN)):
        for i in may(now, pattern):
            if edits := rule(now[i]):
                steps[i].append(Rewritten(now[i], edits))
                now[i] = steps[i][-1].text
    out = []
    for text, base, own in zip(now, bases, steps):
        known, added = set(base), []
        for start, kind, end in detect(text) if own else []:
            a, b, puts = start, end, []
            for s in reversed(own):
                a, b = s.back(a, b)
                puts += s.inside(a, b)
            overlap = any(k == kind and x < b and a < y for x, k, y in base)
            if puts and (a, kind, b) not in known and not (overlap and not set("".join(puts)) - set(" -")):
                added.append((a, kind, b))
        out.append(added)
    return out


def spans(texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Plain spans of each text, and all spans."""
    base: list[list[Span]] = [[] for _ in texts]
    for i in may(texts, MAY_HOLD):
        base[i] = detect(texts[i])
    return base, [sorted({*b, *d}) for b, d in zip(base, disguised(texts, base))]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each row of (doc_id, text): lists of (kind, start, end) in code points, end exclusive, by
    start, then kind. base holds what stands there plainly, spans what is disguised as well; base spans always stay.

    A null or empty text has none. Rows are judged one by one: null and repeated ids, repeated rows and extra columns of
    any name change nothing; no rows give no rows. Whole texts are read, whatever their length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches):
            told = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row] for row in found], item) for found in spans(pc.fill_null(batch.column(1), "").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told], names=["doc_id", "base", "spans"])

    each = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, base {each}, spans {each}")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in angle brackets; of spans that overlap the one
    that starts first gives the name, and all of their text goes. Other columns, null and clean texts stay as they are."""
    place = docs.columns.index("text")

    def mended(text: str, found: list[Span]) -> str:
        out, at = [], 0
        for a, k, b in sorted(found, key=lambda s: (s[0], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, place):
            texts = batch.column(place).to_pylist()
            new = [x and mended(x, found) for x, found in zip(texts, spans([x or "" for x in texts])[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(new, batch.schema.field(place).type), *batch.columns[place + 1 :]], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op13_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain spans of every document, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *n, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
