"""Which stretches of documents repeat: shared by the substring and the suffix-array deduplication.

A document's windows of the target length are dealt into segments: neighbouring windows that hold the same least
hash (the anchor) of a shorter length. Equal windows have equal anchors wherever they stand, so a window can repeat
only inside segments of one anchor. Equal whole segments settle all their windows at once; only segments that share
an anchor but differ (parts) need a look at single windows, and of equal ones only the first.

Before the shuffle each task keeps, of equal segments that it sees together, the first document's alone, so a passage
in a third of all documents sends a row for each piece of input, not for each document. After it, rows stream in
order of (anchor, segment, document, place); no group is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import text as tx

ROWS = "anchor long, seg long, doc_id long, lo int, n int, known boolean"
FLAGS = "doc_id long, lo int, n int, anchor long"  #: anchor: of parts; null where the segment is settled


def segments(low: np.ndarray, first: np.ndarray, target: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each segment, and its row. low: the anchor of each window, first: where each row
    starts; windows that would leave their row are left out, segments have ``most`` windows at most."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(low)]
    place = np.flatnonzero(np.arange(len(low)) + target <= first[row + 1])
    if not len(place):
        return place, place, place
    size = np.bincount(row[place])
    some = np.flatnonzero(size)
    return segments_in(low, first[some], size[some], some, most)


def segments_in(low: np.ndarray, start: np.ndarray, n: np.ndarray, of: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of stretches of windows only: their first windows, numbers of windows (one at least) and rows."""
    if not len(start):
        return start, start, of
    place, part = stretches(start, n), np.repeat(np.arange(len(n)), n)
    anchor = low[place]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
    head = np.flatnonzero(new)
    since = np.arange(len(place)) - np.repeat(head, np.diff(np.concatenate((head, [len(place)]))))
    head = np.flatnonzero(since % most == 0)
    return place[head], place[np.concatenate((head[1:], [len(place)])) - 1], of[part[head]]


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all stretches, one stretch after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def sent(anchor, seg, doc, lo, n, same_doc: bool, more: pa.Array | None = None) -> pa.RecordBatch:
    """ROWS (and a column more) of the segments of one piece. known: an equal segment of an earlier document stands in the
    same piece; same_doc: one earlier in its own document counts, too."""
    order = np.lexsort((lo, doc, seg, anchor))
    anchor, seg, doc, lo, n = (x[order] for x in (anchor, seg, doc, lo, n))
    head = _heads(anchor, seg)
    lead = np.repeat(head, np.diff(np.concatenate((head, [len(seg)]))))
    known = doc > doc[lead]
    if same_doc:
        known |= lo > lo[lead]
    # what is known passes through: it is dealt by its own place
    anchor = np.where(known, tx.mix(doc.astype(np.uint64) * tx.BASE + lo.astype(np.uint64)), anchor)
    columns = [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(known)]
    names = [c.split()[0] for c in ROWS.split(", ")]
    if more is None:
        return pa.RecordBatch.from_arrays(columns, names=names)
    return pa.RecordBatch.from_arrays([*columns, more.take(pa.array(order))], names=[*names, "more"])


def rows_of(docs: DataFrame, cut: Callable, same_doc: bool, piece_bytes: int = tx.PIECE) -> DataFrame:
    """ROWS of (doc_id, text). cut: bytes and row starts to (anchor, segment hash, row, first window in the row, windows;
    windows below zero: as many, and some of them may be equal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, most=piece_bytes):
            ids = np.asarray(piece.column("doc_id")).astype(np.int64)
            anchor, seg, row, lo, n = cut(*tx.as_bytes(piece.column("text")))
            yield sent(anchor, seg, ids[row], lo, n, same_doc)

    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, ROWS)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def flags_of(rows: DataFrame, same_doc: bool) -> DataFrame:
    """FLAGS: segments with an equal one before them (settled), and parts: segments, first of their kind, that share an
    anchor with others. A column ``more`` of rows goes with them. Equal rows, of a repeated row of documents, are one."""
    names = [c.split()[0] for c in FLAGS.split(", ")]
    extra = rows.columns[6:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the group that is open: anchor, segment, first document and place, and whether its anchor has others
        held: list[pa.RecordBatch] = []  # first rows of the open group

        def out(batch: pa.RecordBatch, mask: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
            got, part = batch.filter(pa.array(mask)), part[mask]
            n = np.abs(np.asarray(got.column(4))).astype(np.int32)
            anchor = pa.array(np.asarray(got.column(0)), mask=~part)
            return pa.RecordBatch.from_arrays([got.column(2), got.column(3), pa.array(n), anchor, *(got.column(c) for c in extra)], names=[*names, *extra])

        def every(batch: pa.RecordBatch, part: bool) -> pa.RecordBatch:
            return out(batch, np.ones(batch.num_rows, bool), np.full(batch.num_rows, part))

        for batch in batches:
            known = batch.column(5).to_numpy(zero_copy_only=False)
            if known.any():
                yield out(batch, known, np.zeros(len(known), bool))
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            anchor, seg, doc, lo, n = (np.asarray(batch.column(i)) for i in range(5))
            goes_on = last is not None and last[0] == anchor[0] and last[1] == seg[0]
            head = _heads(anchor, seg)
            size = np.diff(np.concatenate((head, [len(anchor)])))
            g_anchor, g_doc, g_lo = anchor[head], doc[head].copy(), lo[head].copy()
            more = np.zeros(len(head), bool)
            more[1:] |= g_anchor[1:] == g_anchor[:-1]
            more[:-1] |= g_anchor[1:] == g_anchor[:-1]
            if goes_on:
                g_doc[0], g_lo[0], more[0] = last[2], last[3], more[0] | last[4]
            elif last is not None and last[0] == anchor[0]:
                more[0] = True
            if held and (more[0] if goes_on else last[0] == anchor[0]):
                for h in held:
                    yield every(h, True)
                held = []
            elif not goes_on:
                held = []
            leads = doc == np.repeat(g_doc, size)
            if same_doc:
                leads &= lo == np.repeat(g_lo, size)
            part = leads & (np.repeat(more, size) | (n < 0))
            yield out(batch, ~leads | part, part)
            if more[-1]:
                held = []
            else:
                own = leads & ~part
                own[: head[-1]] = False
                held = (held if goes_on and len(head) == 1 else []) + [batch.filter(pa.array(own))]
            last = (g_anchor[-1], seg[-1], g_doc[-1], g_lo[-1], bool(more[-1]))

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "seg", "doc_id", "lo")
    return dealt.mapInArrow(run, FLAGS + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in extra))


def spans(flags: DataFrame) -> DataFrame:
    """One row for each document that has flags; as many as the document has segments at most."""
    return flags.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "anchor")).alias("spans"))


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's spans: where each row's start (one more at the end), lo, n, anchor, and whether they are parts."""
    at = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))))
    lo, n, anchor = column.flatten().flatten()
    return at, np.asarray(lo).astype(np.int64), np.asarray(n).astype(np.int64), np.asarray(anchor.fill_null(0)), np.asarray(anchor.is_valid())
