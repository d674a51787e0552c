"""Substring deduplication by level-wise doubling over word windows.

Level by level, windows of ``start`` words, of twice as many, and so on up to ``target`` words are counted, one for each
segment (see ``repeats``): a stretch of target windows that all hold the same least hash of a window of the level.
Stretches whose window of the level stands nowhere else go no further; the others are cut anew by windows of twice the
length, until no candidates survive. Equal whole stretches settle all their windows on any level. On the last level a
window of the level is a whole target window, so every candidate is settled there. The doubling ends at ``target``, as
longer windows cannot cover a word that windows of ``target`` words do not. Most of the corpus is shuffled once, as one
small row for each stretch of the first level; texts of documents with candidates are kept in buckets and not moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import repeats, store
from metascrub.llm import text as tx

STATE = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, gone binary"
DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, gone binary"


def widths(start: int, target: int) -> list[int]:
    """The levels' window lengths: doubled from start on, the last one is target."""
    out = [start]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def cut(width: int, target: int):
    """Segments of target windows by the least hash of their windows of ``width`` words, for repeats.rows_of; of places only, if given."""
    span = target - width + 1

    def run(data: np.ndarray, at: np.ndarray, parts: tuple | None = None):
        _, _, hashes, first = tx.words(data, at)
        low = tx.lowest(tx.mix(tx.windows(hashes, width)), span)
        if parts is None:
            lo, hi, row = repeats.segments(low, first, target, span)
        else:
            row, lo, n = parts
            inside = lo + n + target - 1 <= np.diff(first)[row]  # of another text, where doc_id repeats
            row, lo, n = row[inside], lo[inside], n[inside]
            lo, hi, row = repeats.segments_in(low, first[row] + lo, n, row, span)
        whole = tx.windows(hashes, target)
        if not len(lo):
            return np.empty(0, np.uint64), np.empty(0, np.uint64), row, lo, hi
        # two windows of target words cover a segment, as it has fewer windows than that
        seg = tx.mix(whole[lo] * tx.BASE + tx.mix(whole[hi] + (hi - lo).astype(np.uint64)))
        return low[lo], seg, row, lo - first[row], hi - lo + 1

    return run


def digest(text: bytes, gone: np.ndarray | None) -> tuple[int, int, str]:
    """Words, removed words and the SHA-256 of the kept words joined by a space."""
    found = text.split()
    kept = found if gone is None else list(compress(found, ~gone))
    return len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=list(names))


def dedup(docs: DataFrame, target: int = 50, start: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, gone (a bit for each word of documents that lose words, else null).

    A word goes if a window of ``target`` words that covers it also starts in a document with a smaller doc_id. A null
    text is empty: no words. Rows with a null doc_id keep all words and are no source. doc_id should be unique; rows
    that share one neither remove each other's words, and words that go in one go at the same places in all of them.
    Extra columns are ignored; an empty table gives no rows. start: words of the first level's windows, at most target;
    the result is the same with any."""
    if not 1 <= start <= target:
        raise ValueError("start must be from 1 to target")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = widths(start, target)
    flags = store.saved(repeats.flags_of(repeats.rows_of(docs, cut(levels[0], target), False), False), "substring-level")
    joined = docs.join(repeats.spans(flags), "doc_id", "left")

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches):
            rows, bounds = [], repeats.span_arrays(piece.column(2))
            for k, (doc, text) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                raw = (text or "").encode()
                lo, n, _, part = (x[bounds[0][k] : bounds[0][k + 1]] for x in bounds[1:])
                if not len(lo):
                    rows.append((doc, *digest(raw, None), None, None))
                    continue
                length = len(raw.split())
                gone = settled(length, lo[~part], n[~part])
                bits = np.packbits(gone).tobytes()
                rows.append((doc, length, None, None, text, bits) if part.any() else (doc, *digest(raw, gone), None, bits))
            yield _batch(rows, STATE)

    def settled(length: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The words of segments that repeat; segments of another text, where doc_id repeats, don't count."""
        inside = lo + n + target - 1 <= length
        return tx.covered(length, lo[inside], (lo + n + target - 1)[inside])

    state = store.bucketed(joined.mapInArrow(first_level, STATE), "substring-state", "doc_id")
    open_ = state.filter("text is not null")
    hits = None
    for width in levels[1:]:
        parts = flags.filter("anchor is not null")
        if parts.isEmpty():
            break
        texts = open_.select("doc_id", "text").join(repeats.spans(parts), "doc_id")
        flags = store.saved(repeats.flags_of(_rows_in(texts, cut(width, target)), False), "substring-level")
        found = flags.filter("anchor is null").select("doc_id", "lo", "n", "anchor")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = flags.limit(0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches):
            rows, bounds = [], repeats.span_arrays(piece.column(4))
            for k, (doc, length, text, bits) in enumerate(zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True)):
                gone = np.unpackbits(np.frombuffer(bits, np.uint8), count=length).astype(bool)
                gone |= settled(length, *(x[bounds[0][k] : bounds[0][k + 1]] for x in bounds[1:3]))
                rows.append((doc, *digest(text.encode(), gone), np.packbits(gone).tobytes() if gone.any() else None))
            yield _batch(rows, DONE)

    done = open_.select("doc_id", "n_words", "text", "gone").join(repeats.spans(hits), "doc_id", "left").mapInArrow(finish, DONE)
    return state.filter("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "gone").unionByName(done)


def _rows_in(texts: DataFrame, cutter) -> DataFrame:
    """repeats.ROWS of the spans of (doc_id, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches):
            ids = np.asarray(piece.column(0)).astype(np.int64)
            at, lo, n, _, _ = repeats.span_arrays(piece.column(2))
            anchor, seg, row, lo, n = cutter(*tx.as_bytes(piece.column(1)), (np.repeat(np.arange(piece.num_rows), np.diff(at)), lo, n))
            yield repeats.sent(anchor, seg, ids[row], lo, n, False)

    return texts.mapInArrow(run, repeats.ROWS)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words removed from each document, with windows of 50 words."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("gone")
