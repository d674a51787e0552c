"""Suffix-array deduplication by merging Burrows-Wheeler transforms.

Where repeats can be is found by segments (see ``repeats``): anchors are least hashes of 32 bytes among 69 that follow
each other. Only distinct segments that share an anchor but differ go on, to the task of their anchor. Hashes of their
windows tell which stretches are to be loaded; equal stretches are one string. Shards of these strings get suffix arrays
and transforms of their own, which are merged by iterative interleave refinement: each round sorts the interleave
stably by the transforms' characters, so after h rounds it is in order of the first h bytes of all suffixes, and what
is left in it has a common prefix of h bytes with another suffix. The blocks left after ``length`` rounds are the
repeated intervals. No suffix is sorted again. Which windows are equal is read from the intervals alone.

Equal windows have equal anchors, so intervals never reach over tasks. The segments of a hot anchor (a license line in
different surroundings) are dealt by the hashes of their windows first: what no other one has falls off there, what is
left are copies of few strings, and these are merged like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import repeats, store
from metascrub.llm import text as tx

LENGTH, ANCHOR = 100, 32
SPAN = LENGTH - ANCHOR + 1  #: windows of an anchor, and hashes of a window
PIECE = 1 << 20  #: bytes of text handled at once
MERGE = 2 << 20  #: bytes of segments that are looked at together
SHARD = 1 << 17  #: bytes of one shard
HOT = 4096  #: segments of one anchor beyond which it is hot
STATE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, gone binary, parts array<struct<lo:int,n:int,anchor:long>>"
DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SEGMENTS = "anchor long, doc_id long, lo int, seg binary"
FOUND = "doc_id long, lo int, n int"


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[: max(0, len(x) - k)] | (x[k:] << np.uint64(8 * k))
    return x


def _odd(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)


def anchors(x: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    n = max(0, len(x) - ANCHOR + 8)
    h = np.zeros(n, np.uint64)
    for k in range(ANCHOR // 8):
        h = tx.mix(h + x[8 * k : 8 * k + n] * _odd(k)) if k == ANCHOR // 16 else h + x[8 * k : 8 * k + n] * _odd(k)
    return tx.mix(h)


def windows_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each of the places on."""
    h = np.zeros(len(at), np.uint64)
    for k, off in enumerate([*range(0, LENGTH - 7, 8), LENGTH - 8]):
        h = tx.mix(h ^ (x[at + off] * _odd(k)))
    return h


def windows_of(data: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each place on."""
    return tx.windows(tx.mix(eights(data)), LENGTH - 7)


def cut(data: np.ndarray, at: np.ndarray):
    """Segments of byte windows, for repeats.rows_of."""
    x = eights(data)
    k = anchors(x)
    low = tx.lowest(k, SPAN)
    lo, hi, row = repeats.segments(low, at, LENGTH, SPAN)
    if not len(lo):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), row, lo, lo
    seg = tx.mix(windows_at(x, lo) * tx.BASE + tx.mix(windows_at(x, hi) + (hi - lo).astype(np.uint64)))
    # equal windows inside one segment bring the anchor twice
    n = hi - lo + SPAN
    head = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(head - lo, n)
    twice = np.add.reduceat((k[place] == np.repeat(low[lo], n)).astype(np.int64), head) > 1
    return low[lo], seg, row, lo - at[row], np.where(twice, lo - hi - 1, hi - lo + 1)


def suffixes(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in order of the LENGTH bytes from there, cut at the end of the string. left: bytes to that end, the end
    mark (0, other bytes are 1 to 256) included. Ranks of 4, 8, 16, ... bytes come from each other."""
    rank, h = np.zeros(len(data), np.int64), 4
    for k in range(4):
        ahead = np.zeros(len(data), np.int64)
        ahead[: max(0, len(data) - k)] = data[k:]
        ahead[left <= k] = 0
        rank = rank * 257 + ahead
    rank = np.unique(rank, return_inverse=True)[1]
    while h < LENGTH:
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - h)] = rank[h:] + 1
        ahead[left <= h] = 0
        rank = np.unique(rank * (len(data) + 2) + ahead, return_inverse=True)[1]
        h *= 2
    return np.argsort(rank, kind="stable")


def merged_blocks(shards: list[tuple[np.ndarray, np.ndarray]], rounds: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (offset by shard) of the suffixes whose first ``rounds`` bytes are those of another, in merged order; the
    number of each one's block of equal ones; and of every place the common prefix with its neighbours in merged order
    (the longest one with any other suffix), of ``rounds`` bytes at most.

    The interleave is kept as rows of the shards' transforms. A round sorts it stably by the rows' characters and moves
    each row to that of the suffix one byte longer. A row that is alone in its block is done: no longer suffix of it can
    repeat, so it leaves the interleave."""
    row, bwt, step, places, offset = [], [], [], [], 0
    for data, left in shards:
        sa = suffixes(data, left)
        at = np.empty(len(sa), np.int32)
        at[sa] = np.arange(len(sa), dtype=np.int32)
        bwt.append(data[sa - 1])  # before a string's first byte stands an end mark
        step.append(at[sa - 1] + np.int32(offset))
        row.append(np.arange(offset, offset + len(sa), dtype=np.int32))
        places.append(sa + offset)
        offset += len(sa)
    row, step, places = np.concatenate(row), np.concatenate(step), np.concatenate(places)
    letters, bwt = np.unique(np.concatenate(bwt), return_inverse=True)
    bwt = bwt.astype(np.uint8 if len(letters) <= 256 else np.uint16)
    if letters[0] != 0:
        raise AssertionError("strings end with a mark")
    block, common = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
    for h in range(1, rounds + 1):
        chars = bwt[row]
        turn = np.argsort(chars, kind="stable")
        turn = turn[np.searchsorted(chars, 1, sorter=turn) :]  # nothing stands before a string
        chars, row, block = chars[turn], step[row[turn]], block[turn]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (chars[1:] != chars[:-1]) | (block[1:] != block[:-1])
        more = ~(new[:-1] & new[1:])
        row, block = row[more], np.cumsum(new[:-1], dtype=np.int32)[more]
        common[places[row]] = h
    return places[row], block, common


def solve(data: np.ndarray, at: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows) of the stretches that repeat what stands before them. data, at: the bytes of segments
    and their starts; doc, lo: where they stand."""
    size = np.diff(at)
    inside = np.maximum(size - LENGTH + 1, 0)
    place, seg = repeats.stretches(at[:-1], inside), np.repeat(np.arange(len(size)), inside)
    none = np.empty(0, np.int64)
    if not len(place):
        return none, none, none
    h = windows_of(data)[place]
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    # stretches whose windows all have an equal hash somewhere
    joined = np.zeros(len(h) + 1, bool)
    joined[1:-1] = again[1:] & again[:-1] & (seg[1:] == seg[:-1])
    first, last = np.flatnonzero(again & ~joined[:-1]), np.flatnonzero(again & ~joined[1:])
    if not len(first):
        return none, none, none
    n = last - first + 1
    d, w = doc[seg[first]], lo[seg[first]] + place[first] - at[seg[first]]
    # two windows cover a stretch, as it has fewer windows than that; equal stretches are one string, told by its first
    key = tx.mix(h[first] * tx.BASE + tx.mix(h[last] + n.astype(np.uint64)))
    order = np.lexsort((w, d, key))
    head = repeats._heads(key[order])
    lead = np.repeat(order[head], np.diff(np.concatenate((head, [len(order)]))))
    later = (d[order] > d[lead]) | (w[order] > w[lead])
    later = order[later]
    own = order[head]
    d0, w0, n0 = d[own], w[own], n[own]
    string, off = merged(data, place[first[own]], n0 + LENGTH - 1)
    dw, ww = d0[string[0]], w0[string[0]] + off
    order = np.lexsort((ww, dw, string[1]))
    block, dw, ww = string[1][order], dw[order], ww[order]
    head = repeats._heads(block)
    lead = np.repeat(head, np.diff(np.concatenate((head, [len(block)]))))
    hit = (dw > dw[lead]) | (ww > ww[lead])
    dw, ww = dw[hit], ww[hit]
    order = np.lexsort((ww, dw))
    dw, ww = dw[order], ww[order]
    head = repeats._heads(dw, ww - np.arange(len(ww)))
    runs = np.diff(np.concatenate((head, [len(ww)])))
    return np.concatenate((d[later], dw[head])), np.concatenate((w[later], ww[head])), np.concatenate((n[later], runs))


def merged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((string, block), place in the string) of the windows of strings that equal another one; the merged transforms of their shards."""
    end = np.cumsum(size + 1)
    text = np.zeros(end[-1], np.int16)
    string = np.repeat(np.arange(len(size)), size + 1)
    off = np.arange(end[-1]) - np.repeat(end - size - 1, size + 1)
    text[off < size[string]] = data[repeats.stretches(start, size)].astype(np.int16) + 1
    left = size[string] + 1 - off
    shards, k = [], 0
    while k < len(size):
        begin = end[k] - size[k] - 1
        j = max(k + 1, int(np.searchsorted(end, begin + SHARD, "right")))
        shards.append((text[begin : end[j - 1]], left[begin : end[j - 1]]))
        k = j
    place, block, _ = merged_blocks(shards)
    keep = left[place] > LENGTH
    place, block = place[keep], block[keep]
    return (string[place], block), off[place]


def digest(raw: bytes, gone: np.ndarray | None) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, runs of them and the SHA-256 of the kept bytes."""
    if gone is None or not gone.any():
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    kept = np.frombuffer(raw, np.uint8)[~gone]
    return len(raw), int(gone.sum()), len(tx.runs(gone)[0]), hashlib.sha256(kept).hexdigest()


def _out(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split()[0] for c in schema.split(", ")]
    types = [kinds.get(c.split()[1], pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64())]))) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns or [[]] * len(names), types, strict=True)], names=names)


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or in the same
    document before. A null text is empty. Rows with a null doc_id keep all and are no source. doc_id should be unique:
    equal rows that share one are one document, which keeps its bytes in each; different ones lose bytes at the same
    places. Extra columns are ignored; an empty table gives no rows. hot: segments of one anchor beyond which they are
    dealt by their windows first; the result is the same with any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flags = repeats.flags_of(repeats.rows_of(docs, cut, True, PIECE), True)
    joined = docs.join(repeats.spans(flags), "doc_id", "left")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, most=PIECE):
            rows, bounds = [], repeats.span_arrays(piece.column(2))
            for k, (doc, text) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                raw = (text or "").encode()
                lo, n, anchor, part = (x[bounds[0][k] : bounds[0][k + 1]] for x in bounds[1:])
                if not len(lo):
                    rows.append((doc, *digest(raw, None), None, None, None))
                    continue
                inside = lo + n + LENGTH - 1 <= len(raw)  # of another row, where doc_id repeats
                if not inside.all():
                    lo, n, anchor, part = (x[inside] for x in (lo, n, anchor, part))
                gone = tx.covered(len(raw), lo[~part], (lo + n + LENGTH - 1)[~part])
                if not part.any():
                    rows.append((doc, *digest(raw, gone), None, None, None))
                else:
                    rows.append((doc, len(raw), None, None, None, text, np.packbits(gone).tobytes(), [{"lo": a, "n": b, "anchor": c} for a, b, c in zip(lo[part].tolist(), n[part].tolist(), anchor[part].tolist(), strict=True)]))
            yield _out(STATE, list(zip(*rows, strict=True)))

    state = store.bucketed(joined.mapInArrow(extend, STATE), "suffix-state", "doc_id")
    open_ = state.filter("parts is not null")
    parts = open_.select("doc_id", "text", "parts").mapInArrow(_segments, SEGMENTS)
    warm = store.saved(open_.select(F.explode("parts.anchor").alias("anchor")).groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "suffix-hot")
    if warm.isEmpty():
        found = _merged(parts)
    else:
        trimmed = store.saved(repeats.flags_of(_dealt(parts.join(warm, "anchor")), True), "suffix-trimmed")
        rest = trimmed.filter("anchor is not null").select("anchor", "doc_id", "lo", F.col("more").alias("seg"))
        found = _merged(parts.join(warm, "anchor", "left_anti").unionByName(rest)).unionByName(trimmed.filter("anchor is null").select("doc_id", "lo", "n"))
    hits = found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", F.lit(None).cast("long").alias("anchor"))).alias("hits"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, most=PIECE):
            rows, bounds = [], repeats.span_arrays(piece.column(3))
            for k, (doc, text, bits) in enumerate(zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True)):
                raw = text.encode()
                gone = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(raw)).astype(bool)
                lo, n = (x[bounds[0][k] : bounds[0][k + 1]] for x in bounds[1:3])
                inside = lo + n + LENGTH - 1 <= len(raw)
                rows.append((doc, *digest(raw, gone | tx.covered(len(raw), lo[inside], (lo + n + LENGTH - 1)[inside]))))
            yield _out(DONE, list(zip(*rows, strict=True)))

    done = open_.select("doc_id", "text", "gone").join(hits, "doc_id", "left").mapInArrow(finish, DONE)
    return state.filter("parts is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(done)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEGMENTS: the bytes of the parts."""
    for piece in tx.pieces(batches, most=PIECE):
        data, start = tx.as_bytes(piece.column(1))
        at, lo, n, anchor, _ = repeats.span_arrays(piece.column(2))
        row, size = np.repeat(np.arange(piece.num_rows), np.diff(at)), n + LENGTH - 1
        for s in range(0, len(lo), 20_000):
            k = slice(s, s + 20_000)
            seg = _binary(data[repeats.stretches(start[row[k]] + lo[k], size[k])], size[k])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[k]), piece.column(0).take(pa.array(row[k])), pa.array(lo[k].astype(np.int32)), seg], names=["anchor", "doc_id", "lo", "seg"])


def _merged(parts: DataFrame) -> DataFrame:
    """FOUND of SEGMENTS."""
    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge, FOUND)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND: the groups of anchors in turn, about MERGE bytes of whole groups at once."""
    held: list[pa.RecordBatch] = []
    size = 0

    def answer() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        doc, lo = (np.asarray(table.column(k).combine_chunks()).astype(np.int64) for k in (1, 2))
        d, w, n = solve(*tx.as_bytes(table.column(3).combine_chunks()), doc, lo)
        return _out(FOUND, [d, w.astype(np.int32), n.astype(np.int32)])

    for batch in batches:
        anchor = np.asarray(batch.column(0))
        ends = np.concatenate((np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [batch.num_rows]))
        bytes_to = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(3))))
        start = 0
        if held and batch.num_rows and held[-1].column(0)[-1].as_py() != anchor[0] and size > MERGE:
            yield answer()
            held, size = [], 0
        while start < batch.num_rows:
            before = bytes_to[start - 1] if start else 0
            k = min(int(np.searchsorted(bytes_to[ends - 1], before + MERGE - size)), len(ends) - 1)
            end = int(ends[max(k, int(np.searchsorted(ends, start, "right")))])
            held.append(batch.slice(start, end - start))
            size += int(bytes_to[end - 1] - before)
            start = end
            if start < batch.num_rows and size > MERGE:
                yield answer()
                held, size = [], 0
    if held:
        yield answer()


def _dealt(parts: DataFrame) -> DataFrame:
    """repeats.ROWS, with their bytes (more), of the stretches of hot anchors' segments whose windows all stand in another
    segment or twice in their own, by hash. A piece sends one row for each hash."""
    rows = "hash long, anchor long, doc_id long, lo int, off int, answer boolean, twice boolean"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "seg", PIECE):
            data, at = tx.as_bytes(piece.column("seg"))
            inside = np.maximum(np.diff(at) - LENGTH + 1, 0)
            place, row = repeats.stretches(at[:-1], inside), np.repeat(np.arange(piece.num_rows), inside)
            h = windows_of(data)[place].view(np.int64)
            order = np.argsort(h, kind="stable")
            h, row, off = h[order], row[order], (place - at[row])[order]
            head = repeats._heads(h)
            size = np.diff(np.concatenate((head, [len(h)])))
            lead = np.zeros(len(h), bool)
            lead[head] = True
            own = np.repeat(size > 1, size)
            # what stands twice here needs no answer: one row tells the others of it, all are dealt by their places
            told = tx.mix(np.asarray(piece.column("doc_id")).astype(np.uint64)[row] * tx.BASE + (np.asarray(piece.column("lo")).astype(np.int64)[row] + off).astype(np.uint64)).view(np.int64)
            many = np.flatnonzero(lead & own)
            take = np.concatenate((np.arange(len(h)), many))
            hashes = np.concatenate((np.where(own, told, h), h[many]))
            answer = np.concatenate((np.ones(len(h), bool), np.zeros(len(many), bool)))
            twice = np.concatenate((own, np.ones(len(many), bool)))
            of = pa.array(row[take])
            yield pa.RecordBatch.from_arrays([pa.array(hashes), piece.column("anchor").take(of), piece.column("doc_id").take(of), piece.column("lo").take(of), pa.array(off[take].astype(np.int32)), pa.array(answer), pa.array(twice)], names=[c.split()[0] for c in rows.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, as long as it waits: hash, and the row where it needs an answer
        for batch in batches:
            if not batch.num_rows:
                continue
            h, answer, twice = np.asarray(batch.column(0)), batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).to_numpy(zero_copy_only=False)
            got = twice.copy()
            got[1:] |= h[1:] == h[:-1]
            got[:-1] |= h[1:] == h[:-1]
            if last is not None and last[0] == h[0]:
                got[0] = True
                if last[1] is not None:
                    yield last[1].select([1, 2, 3, 4])
            got_now = got & answer
            if not got[-1]:
                last = (h[-1], batch.slice(batch.num_rows - 1) if answer[-1] else None)
            else:
                last = (h[-1], None)
            yield batch.filter(pa.array(got_now)).select([1, 2, 3, 4])

    windows = parts.mapInArrow(send, rows).repartition("hash").sortWithinPartitions("hash").mapInArrow(scan, "anchor long, doc_id long, lo int, off int")
    places = windows.groupBy("anchor", "doc_id", "lo").agg(F.array_sort(F.collect_set("off")).alias("offs"))  # SPAN at most

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "seg", PIECE):
            data, at = tx.as_bytes(piece.column("seg"))
            offs = piece.column("offs")
            row = np.repeat(np.arange(piece.num_rows), np.asarray(pa.compute.list_value_length(offs)))
            off = np.asarray(offs.flatten()).astype(np.int64)
            head = repeats._heads(row, off - np.arange(len(off)))
            n = np.diff(np.concatenate((head, [len(off)])))
            row, off = row[head], off[head]
            h, start = windows_of(data), at[row] + off
            seg = tx.mix(h[start] * tx.BASE + tx.mix(h[start + n - 1] + n.astype(np.uint64)))
            take = lambda c: np.asarray(piece.column(c))[row]
            size = n + LENGTH - 1
            yield repeats.sent(take("anchor").view(np.uint64), seg, take("doc_id"), take("lo").astype(np.int64) + off, -n, True, _binary(data[repeats.stretches(start, size)], size))

    return parts.join(places, ["anchor", "doc_id", "lo"]).select("anchor", "doc_id", "lo", "seg", "offs").mapInArrow(trim, repeats.ROWS + ", more binary")


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes removed from each document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
