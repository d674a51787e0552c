"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines.

Features are hashed runs of 1 to 4 bytes of the lower-cased letters of the whole text, with one space between words,
scaled to length one. The family is told by one multinomial model over all families. The languages of a family are told
apart by machines, one for each two of them. All are fitted on every labelled row: the counts of runs are written once, and
each step of the descent is one job that sums losses and gradients of all models over all rows. Every language weighs the
same, however many rows it has. A family with one language needs no further machine. Every label value is learned.

Machines tell learned languages apart; they cannot tell that a text is in none. For that each language has an outlier
model: how much likelier its runs are than runs of no language at all, for a text and its predicted language the mean
over the text's runs, and the share of letters. Both have floors below what labelled rows get, each judged by the runs of
the half of the rows that it is not in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metascrub.llm import store
from metascrub.llm import text as tx

DIM = 4096
REG = 1e-4  #: weight of the squared length of a model's weights
KEPT = 8  #: steps that the descent remembers
FIRST = 4.0  #: length of the first step, times the gradient
TRIED = (1.0, 0.25)  #: lengths of a step that are tried in one job
CLOSE = 100_000  #: quantiles are exact to one in this many rows
#: Families of closely related languages. A language that is not here is its own family.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
}
BLOCK = 64  #: rows of counts that are kept as one
COUNT = np.arange(256, dtype=np.float32)
ROOT = np.sqrt(COUNT)
LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])
TIMES = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
ENOUGH = 256  #: letter bytes beyond which a text's mean over its runs is taken to be as sure as can be
LEAST_ROWS = 20  #: of a language with fewer judged texts nothing is rejected
MOST_SHARE = 0.5  #: a text with this share of letters is not rejected for the share
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte runs of each text and where each text's runs start (one more at the end)."""
    data, at = tx.as_bytes(pa.array([(t or "").lower() + " " for t in texts], pa.large_string()))
    letter = LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    b = np.where(letter, data, 32)[keep].astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(keep)))[at]
    left = np.repeat(start[1:], np.diff(start)) - np.arange(len(b))  # bytes to the end of the text
    out, run = [], np.zeros(len(b), np.uint64)
    for k in range(1, 5):
        run = run[: len(b) - k + 1] * np.uint64(257) + b[k - 1 :] + np.uint64(1) if len(b) >= k else run[:0]
        h = ((run + np.uint64(k)) * TIMES) >> np.uint64(64 - 12)
        h = np.concatenate((h, np.full(len(b) - len(h), DIM, np.uint64)))
        h[left < k] = DIM
        out.append(h)
    return np.stack(out, 1).ravel().astype(np.int32), start * 4


def counts(texts: list[str | None]) -> np.ndarray:
    """How often each of the DIM hashed runs comes in each text."""
    h, at = grams(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    return np.bincount(row * (DIM + 1) + h, minlength=len(texts) * (DIM + 1)).reshape(len(texts), DIM + 1)[:, :DIM]


def vectors(texts: list[str | None]) -> np.ndarray:
    """A row of DIM features for each text."""
    x = np.sqrt(counts(texts).astype(np.float64))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def packed(n: np.ndarray) -> tuple[bytes, bytes]:
    """Rows of counts: their lowest bytes, compressed, and place and count of those that need more than one."""
    at = np.flatnonzero(n > 255)
    return pa.compress(n.astype(np.uint8).tobytes(), codec="zstd", asbytes=True), np.stack((at, n.ravel()[at])).astype(np.int64).tobytes()


def unpacked(x: bytes, more: bytes, rows: int, roots: bool = False) -> np.ndarray:
    """The rows of counts that ``packed`` took, or their square roots."""
    out = (ROOT if roots else COUNT)[np.frombuffer(pa.decompress(x, rows * DIM, codec="zstd"), np.uint8)]
    at, n = np.frombuffer(more, np.int64).reshape(2, -1)
    out[at] = np.sqrt(n) if roots else n
    return out.reshape(rows, DIM)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letter bytes of each text, and their share of the bytes that are no white space."""
    data, at = tx.as_bytes(pa.array([t or "" for t in texts], pa.large_string()))
    upto = lambda marks: np.concatenate(([0], np.cumsum(marks)))[at]
    n, dark = np.diff(upto(LETTER[data])), np.diff(upto(~SPACE[data]))
    return n, n / np.maximum(dark, 1)


def likelier(mean: np.ndarray) -> np.ndarray:
    """The log of how much likelier each run is in a language, of which mean shares are given, than by chance."""
    return np.log(0.9 * mean * DIM + 0.1)


def _half(text: str) -> int:
    return zlib.crc32(text.encode()) & 1


def _middle(text: str) -> str:
    """Eight words from the middle."""
    w = text.split()
    return " ".join(w[len(w) // 2 :][:8])


def _floor(quantiles: list[float]) -> float:
    """Twice as far below the median as one in a hundred of the values is. quantiles: these two."""
    middle, low = quantiles
    return middle - 2 * (middle - low)


def typical(sums: dict, rows: DataFrame) -> dict:
    """Of each language the outlier model (likelier, middle, floor, floor of the letters' share). sums: (lang, half) to summed
    shares of runs and texts; rows: see ``featured``. All rows are judged; the quantiles are theirs to one in CLOSE of them."""
    langs = sorted({lang for lang, _ in sums})
    both = {k: [sum(v[i] for (lang, _), v in sums.items() if lang == k) for i in (0, 1)] for k in langs}
    tables = rows.sparkSession.sparkContext.broadcast({(k, h): likelier(sums[k, 1 - h][0] / sums[k, 1 - h][1]) for k in langs for h in (0, 1) if (k, 1 - h) in sums})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, half, n, share, total, x, more in blocks(batches):
            table = tables.value.get((lang, half))
            if table is not None:
                fit = unpacked(x, more, len(n)) @ table.astype(np.float32) / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(fit, pa.float64()), pa.array(n), pa.array(share)], names=["lang", "fit", "n", "share"])

    judged = store.saved(rows.mapInArrow(run, "lang string, fit double, n long, share double").filter("n > 0"), "langid-fits")
    told = judged.groupBy("lang").agg(F.count("*").alias("rows"), F.percentile_approx("fit", 0.5, CLOSE).alias("middle"), F.percentile_approx("share", [0.5, 0.01], CLOSE).alias("share"))
    told = {r["lang"]: r for r in told.filter(F.col("rows") >= LEAST_ROWS).collect()}
    apart = {}
    if told:
        middle = F.element_at(F.create_map(*[F.lit(x) for k, r in told.items() for x in (k, r["middle"])]), F.col("lang"))
        steps = (F.col("fit") - middle) * F.sqrt(F.least("n", F.lit(ENOUGH)))  # as in _apart
        apart = {r["lang"]: r["q"] for r in judged.filter(F.col("lang").isin(*told)).groupBy("lang").agg(F.percentile_approx(steps, [0.5, 0.01], CLOSE).alias("q")).collect()}
    out = {}
    for k in langs:
        table = likelier(both[k][0] / both[k][1])
        out[k] = (table, told[k]["middle"], _floor(apart[k]), min(MOST_SHARE, _floor(told[k]["share"]))) if k in told else (table, 0.0, -np.inf, 0.0)
    return out


def _apart(fit, n, middle: float):
    """How far a mean over runs is from the middle, in steps that shorter texts make wider."""
    return (fit - middle) * np.sqrt(np.minimum(n, ENOUGH))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_of(known: DataFrame, per_lang: int) -> DataFrame:
    """(lang, text) of at most ``per_lang`` rows of each language, those with the least hash of doc_id. Counts by language (as many
    as the model has languages) tell first which hashes can be among them, so only about twice that many rows are moved."""
    most = {r["lang"]: (2 * per_lang + 200) / r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not most:
        return known.select("lang", "text")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / (1 << 31)
    least = F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    few = known.select("lang", "text", "doc_id", h.alias("h")).filter(F.col("h") < least)
    return few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).select("lang", "text")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``featured``, one by one: lang, half, arrays of n, share and total, and the bytes of x and more."""
    for batch in batches:
        for r in range(batch.num_rows):
            lang, half, n, share, total, x, more = (c[r] for c in batch.columns)
            yield lang.as_py(), half.as_py(), *(c.values.to_numpy() for c in (n, share, total)), x.as_buffer(), more.as_buffer()


def featured(known: DataFrame) -> DataFrame:
    """All labelled texts, each as a whole and by its middle, as short texts are to be told apart, too. A row holds up to BLOCK of
    them, of one language and half: of each n (letter bytes), share (of letters) and total (runs), of all x and more (packed
    counts). The rows are written, as each step of the descent reads them."""
    names = ["lang", "half", "n", "share", "total", "x", "more"]

    def block(key: tuple, some: list) -> pa.RecordBatch:
        n, share, counted = zip(*some, strict=True)
        counted = np.stack(counted)
        row = *key, n, share, counted.sum(1), *packed(counted)
        kinds = pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, list] = {}
        held = 0
        for piece in tx.pieces(batches, most=1 << 19):
            lang, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            for s in range(0, len(texts), BLOCK):
                whole = texts[s : s + BLOCK]
                for some in (whole, [_middle(t) for t in whole]):
                    for name, t, *row in zip(lang[s:], whole, *letters(some), counts(some).astype(np.uint32), strict=False):
                        open_.setdefault((name, _half(t)), []).append(row)
                held += 2 * len(whole)
                for key in [k for k, v in open_.items() if len(v) >= BLOCK or held > 32 * BLOCK]:  # many languages: smaller blocks
                    own = open_.pop(key)
                    held -= len(own)
                    yield from (block(key, own[i : i + BLOCK]) for i in range(0, len(own), BLOCK))
        yield from (block(key, own) for key, own in open_.items())

    rows = store.saved(known.select("lang", "text").mapInArrow(run, "lang string, half int, n array<long>, share array<double>, total array<long>, x binary, more binary"), "langid")
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)  # a task tells one sum for each model


def summed(rows: DataFrame) -> dict:
    """Of each (lang, half) the summed squared features, the number of rows and the summed features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for lang, half, _, _, total, x, more in blocks(batches):
            own = unpacked(x, more, len(total)) / np.maximum(total, 1)[:, None]
            sums[lang, half] = sums.get((lang, half), np.zeros(2 * DIM + 1)) + np.concatenate((own.sum(0), np.sqrt(own).sum(0), [len(own)]))
        for (lang, half), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([half], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["lang", "half", "v"])

    told = rows.mapInArrow(run, "lang string, half int, v array<double>").groupBy("lang", "half").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    out = {(r["lang"], r["half"]): r["v"].toArray() for r in told}
    return {k: (v[:DIM], v[-1], v[DIM:-1]) for k, v in sorted(out.items())}


def slopes(rows: DataFrame, tried: np.ndarray, uses: dict, n_families: int) -> tuple[np.ndarray, np.ndarray]:
    """Losses and gradients of all models over all rows, in one job. tried: by trial and model the weights and the intercept;
    uses: of each language its models (the families' first), its family, the machines' signs and the weight of a row in both."""
    trials, models = tried.shape[:2]
    shared = rows.sparkSession.sparkContext.broadcast((tried.astype(np.float32), uses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, uses = shared.value
        loss, slope = np.zeros((trials, models)), np.zeros((trials, models, DIM + 1))
        for lang, _, _, _, total, x, more in blocks(batches):
            which, family, sign, in_family, in_machine = uses[lang]
            own = unpacked(x, more, len(total), roots=True)
            long = np.sqrt(np.maximum(total, 1)).astype(np.float32)[:, None]  # scales features to length one
            w = weights[:, which].reshape(-1, DIM + 1)
            m = (own @ w[:, :-1].T / long + w[:, -1]).reshape(len(own), trials, len(which))
            off = np.empty_like(m)
            if n_families > 1:
                part = m[:, :, :n_families] - m[:, :, :n_families].max(2, keepdims=True)
                part = part - np.log(np.exp(part).sum(2, keepdims=True))
                loss[:, 0] -= in_family * part[:, :, family].sum(0, dtype=np.float64)
                off[:, :, :n_families] = in_family * (np.exp(part) - (np.arange(n_families) == family))
            short = np.maximum(1 - sign * m[:, :, n_families:], 0)
            loss[:, which[n_families:]] += in_machine * (short**2).sum(0, dtype=np.float64)
            off[:, :, n_families:] = -2 * in_machine * sign * short
            off = off.reshape(len(own), -1)
            slope[:, which, :-1] += ((off / long).T @ own).reshape(trials, len(which), DIM)
            slope[:, which, -1] += off.sum(0, dtype=np.float64).reshape(trials, len(which))
        for t in range(trials):
            for k in range(models):
                yield pa.RecordBatch.from_arrays([pa.array([t * models + k], pa.int32()), pa.array([loss[t, k]]), pa.array([slope[t, k]], pa.list_(pa.float64()))], names=["k", "loss", "slope"])

    told = rows.mapInArrow(run, "k int, loss double, slope array<double>").groupBy("k").agg(F.sum("loss").alias("loss"), Summarizer.sum(array_to_vector("slope")).alias("slope")).collect()
    told = sorted(told, key=lambda r: r["k"])
    return np.array([r["loss"] for r in told]).reshape(trials, models), np.array([r["slope"].toArray() for r in told]).reshape(trials, models, DIM + 1)


def descend(rows: DataFrame, sums: dict, uses: dict, n_families: int, models: int, steps: int) -> np.ndarray:
    """The weights and intercepts of all models, by limited-memory BFGS: of each the squared hinge loss or, of the families' together,
    the multinomial loss. Features count from their mean over languages, which makes the descent short."""
    langs = sorted(uses)
    mean = sum(sum(v[2] for (lang, _), v in sums.items() if lang == k) / sum(v[1] for (lang, _), v in sums.items() if lang == k) for k in langs) / len(langs)
    block = np.maximum(np.arange(models) - max(n_families - 1, 0), 0)  # the families' models are one
    dot = lambda a, b: np.bincount(block, (a * b).sum(1))[block][:, None]

    def at(tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = tried.copy()
        plain[:, :, -1] -= tried[:, :, :-1] @ mean
        loss, slope = slopes(rows, plain, uses, n_families)
        slope[:, :, :-1] += REG * tried[:, :, :-1] - slope[:, :, -1:] * mean
        loss += REG / 2 * (tried[:, :, :-1] ** 2).sum(2)
        return np.array([np.bincount(block, x)[block] for x in loss])[:, :, None], slope

    w = np.zeros((models, DIM + 1))
    loss, slope = (x[0] for x in at(w[None]))
    size, scale, past = np.full((models, 1), FIRST), np.ones((models, 1)), []
    for _ in range(steps):
        d, alphas = slope.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * dot(s, d))
            d -= alphas[-1] * y
        d *= size
        for (s, y, rho), alpha in zip(past, reversed(alphas), strict=True):
            d += s * (alpha - rho * dot(y, d))
        tried = np.array([w - t * scale * d for t in TRIED])
        losses, slopes_at = at(tried)
        best, k = losses.argmin(0), np.arange(models)
        better = losses.min(0) < loss
        new, new_slope = tried[best[:, 0], k], slopes_at[best[:, 0], k]
        s, y = np.where(better, new - w, 0), np.where(better, new_slope - slope, 0)
        w, slope, loss, scale = np.where(better, new, w), np.where(better, new_slope, slope), np.where(better, losses.min(0), loss), np.where(better, 1, scale / 16)
        sy, yy = dot(s, y), dot(y, y)
        bent = sy > 1e-12 * yy
        size = np.where(bent, sy / np.where(bent, yy, 1), size)
        past = [*past, (s, y, np.where(bent, 1 / np.where(bent, sy, 1), 0))][-KEPT:]
    w[:, -1] -= w[:, :-1] @ mean
    return w


def train(docs: DataFrame, per_lang: int | None = None, families: dict[str, str] = FAMILIES, max_iter: int = 15, outliers: bool = False) -> dict:
    """The model: learned languages by family, the family model (names, weights, intercepts), the machines (a, b, weights,
    intercept), of which a positive margin says b, and, with outliers, the languages' outlier models. It is learned from every
    row but those with a null label or text, without a letter, or held out; repeated rows count as often as they come. A caller
    may bound the rows of a language by ``per_lang``; no query does."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out())
    rows = featured(known if per_lang is None else sample_of(known, per_lang))
    sums = summed(rows)
    by_family: dict[str, list[str]] = {}
    for lang in sorted({lang for lang, _ in sums}):
        by_family.setdefault(families.get(lang, lang), []).append(lang)
    names = sorted(by_family)
    pairs = [p for k in names for p in combinations(by_family[k], 2)]
    first = len(names) if len(names) > 1 else 0  # one family needs no model
    w, n_langs = np.zeros((first + len(pairs), DIM + 1)), sum(map(len, by_family.values()))
    uses = {}
    for f, name in enumerate(names):
        for lang in by_family[name]:
            n, own = sum(v[1] for (k, _), v in sums.items() if k == lang), [k for k, p in enumerate(pairs) if lang in p]
            sign = np.array([1 if pairs[k][1] == lang else -1 for k in own], np.float32)
            uses[lang] = (np.array([*range(first), *(first + k for k in own)], np.int64), f, sign, 1 / (n * n_langs), 1 / (2 * n))
    if len(w):
        w = descend(rows, sums, uses, first, len(w), max_iter)
    family = (names, w[:first, :-1], w[:first, -1]) if first else (names, np.zeros((len(names), DIM)), np.zeros(len(names)))
    model = {"families": by_family, "family": family, "machines": [(*p, v[:-1], float(v[-1])) for p, v in zip(pairs, w[first:], strict=True)]}
    if outliers:
        model["typical"] = typical(sums, rows)
    return model


def _vote(names: list[str], margins: dict) -> tuple[str, float]:
    """The name with most wins, ties by the sum of margins and then by name, and how sure its machines are."""
    if len(names) == 1:
        return names[0], 1.0
    won = {k: [0, 0.0] for k in names}
    for (a, b), m in margins.items():
        won[b if m > 0 else a][0] += 1
        won[b][1] += m
        won[a][1] -= m
    best = max(sorted(names), key=lambda k: won[k])
    sure = min(m if b == best else -m for (a, b), m in margins.items() if best in (a, b))
    return best, 1 / (1 + np.exp(-2 * np.clip(sure, -20, 20)))


def predict(docs: DataFrame, model: dict, whole: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; or, with whole, row (a struct of all columns of docs), lang_pred, score and
    fits (whether the text is above the floors of its language's outlier model; true without one). A null text, or one
    without a letter, is ``und`` with score 0, as all are with an empty model. A null doc_id counts as the empty string for
    held_out. Repeated rows give equal results; columns may have any names."""
    machines = model["machines"]
    families, family_w, family_b = model["family"]
    w = np.concatenate((family_w.reshape(len(families), DIM), np.array([m[2] for m in machines]).reshape(len(machines), DIM)))
    bias = np.concatenate((family_b, [m[3] for m in machines]))
    shared = docs.sparkSession.sparkContext.broadcast((model["families"], families, [m[:2] for m in machines], w, bias, model.get("typical", {}) if whole else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_family, families, pairs, w, bias, usual = shared.value
        tables = np.array([u[0] for u in usual.values()])
        place = {k: i for i, k in enumerate(usual)}
        for piece in tx.pieces(batches, most=1 << 19):
            texts = piece.column(1).to_pylist()
            langs, scores, fits = [], [], []
            means, margins = np.zeros((len(usual), len(texts))), np.zeros((len(w), len(texts)))
            n, share = letters(texts) if usual else (None, None)
            if families:
                for s in range(0, len(texts), 64):
                    x = vectors(texts[s : s + 64])
                    margins[:, s : s + 64] = w @ x.T + bias[:, None]
                    if usual:
                        means[:, s : s + 64] = tables @ (x**2).T
            for k, t in enumerate(texts):
                if not families or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    fits.append(not usual)
                    continue
                own = margins[: len(families), k]
                fam = families[int(np.argmax(own))]
                sure = 1 / np.exp(own - own.max()).sum()
                lang, more = _vote(by_family[fam], {p: margins[len(families) + i, k] for i, p in enumerate(pairs) if p[0] in by_family[fam]})
                langs.append(lang)
                scores.append(round(float(sure * more), 9))
                if lang in usual:
                    _, middle, least, few = usual[lang]
                    fits.append(bool(_apart(means[place[lang], k], n[k], middle) >= least and share[k] >= few))
                else:
                    fits.append(True)
            told = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if whole:
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *told, pa.array(fits, pa.bool_())], names=["others", "text", "lang_pred", "score", "fits"])
            else:
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), *told], names=["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string").alias("text")
    if whole:
        # no text goes to the tasks' Python twice: the row goes without a text that is a string
        once = lambda c: c.lower() == "text" and dict(docs.dtypes)[c] == "string"
        rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(docs.columns) if not once(c)]).alias("others"), text)
        told = rows.mapInArrow(run, f"others {rows.schema['others'].dataType.simpleString()}, text string, lang_pred string, score double, fits boolean")
        row = F.struct(*[(F.col("text") if once(c) else F.col(f"others.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
        return told.select(row.alias("row"), "lang_pred", "score", "fits")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, held_out().alias("held_out")).mapInArrow(run, PREDICTED)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
