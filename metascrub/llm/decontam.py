"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes; ASCII capitals count as small letters. Seeds are
runs of ``min_match`` words shared by a document and a benchmark item. Seeds on one diagonal join into matches; the
longest match of unmarked words is marked in both texts again and again (its hashes compared as running Karp-Rabin
hashes) until none of ``min_match`` words is left. An item leaks into a document if the marked words cover
``coverage`` of the item, in whatever order its passages stand.

A benchmark is a stated query set. It is split by the hash of item_id into blocks whose sizes are counted; each block's
seeds go to all tasks and each block makes one pass over the documents, without a shuffle of texts. An item of fewer
than ``min_match`` words is its own seed: it leaks where it stands whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import store
from metascrub.llm import text as tx

BLOCK_BYTES = 16 << 20  #: most bytes of benchmark text whose seeds are sent to the tasks at once
LEAKS = "doc_id long, item_id long, n_item_words long, n_covered long, n_tiles long, coverage double"


def tiles(doc: np.ndarray, item: np.ndarray, shared: np.ndarray, at: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, length) of two word-hash sequences; ``shared`` and ``at`` are the places
    of equal seeds. Ties go to the earliest place in the item, then in the document."""
    free_doc, free_item, found = np.ones(len(doc), bool), np.ones(len(item), bool), []
    span = np.arange(min_match)
    while len(shared):
        open_ = free_doc[shared[:, None] + span].all(1) & free_item[at[:, None] + span].all(1)
        shared, at = shared[open_], at[open_]
        if not len(shared):
            break
        order = np.lexsort((at, shared - at))
        shared, at = shared[order], at[order]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(shared) != 1) | (np.diff(at) != 1))))
        length = np.diff(np.concatenate((cut, [len(shared)]))) + min_match - 1
        best = min(np.flatnonzero(length == length.max()), key=lambda k: (at[cut[k]], shared[cut[k]]))
        d, i, n = int(shared[cut[best]]), int(at[cut[best]]), int(length[best])
        if tx.windows(doc[d : d + n], n)[0] != tx.windows(item[i : i + n], n)[0]:
            raise AssertionError("seeds of a diagonal must make an equal run")
        free_doc[d : d + n], free_item[i : i + n] = False, False
        found.append((d, i, n))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id) with the covered share of the item.

    Null or empty texts match nothing. Repeated doc_id or item_id rows are judged row by row. Extra columns are ignored. An
    empty benchmark or document table gives no rows. Of a benchmark of several blocks, one is held at a time and its rows
    are written before the next."""
    found = None
    for index in _blocks(benchmark, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index[1])
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_leaks_in(shared, min_match, coverage), LEAKS)
        if index[0] > 1:
            rows = store.saved(rows, "leaks")
            shared.destroy()
        found = rows if found is None else found.unionAll(rows)
    return found


def _blocks(benchmark: DataFrame, min_match: int, most: int) -> Iterator[tuple[int, dict]]:
    """(number of blocks, index) of each block: at most ``most`` bytes of text by count, or a single item_id."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most) + 1
    part = lambda k: F.pmod(F.xxhash64("item_id"), F.lit(k))
    while blocks > 1:
        sizes = items.groupBy(part(blocks).alias("k")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("item_id").alias("ids"))
        if not sizes.filter((F.col("bytes") > most) & (F.col("ids") > 1)).limit(1).count():
            break
        blocks *= 2
    for k in range(blocks):
        yield blocks, _index((items.filter(part(blocks) == k) if blocks > 1 else items).collect(), min_match)


def _index(rows: list, min_match: int) -> dict:
    """The items' word hashes and, by width of seed, the seeds in order of the hash with item and place. Width is ``min_match``,
    or the number of words of a shorter item."""
    ids, texts, seeds = [], [], {}
    for row in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])):
        data, at = tx.as_bytes(pa.array([row["text"]], pa.large_string()))
        hashes = tx.words(tx.LOWER[data], at, tx.NOT_ALNUM)[2]
        if not len(hashes):
            continue
        width = min(min_match, len(hashes))
        grams = tx.mix(tx.windows(hashes, width))
        seeds.setdefault(width, []).append((grams, np.full(len(grams), len(ids)), np.arange(len(grams))))
        ids.append(row["item_id"])
        texts.append(hashes)
    widths = {}
    for width, found in seeds.items():
        grams, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(grams, kind="stable")
        maybe = np.zeros(1 << 18, bool)
        maybe[(grams & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        widths[width] = {"grams": grams[order], "item": item[order], "place": place[order], "maybe": maybe}
    return {"ids": ids, "texts": texts, "widths": widths}


def seeds_of(x: dict, width: int, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places in the row, hashes) of the seeds of a width that the rows' words share with items."""
    own = x["widths"][width]
    grams = tx.mix(tx.windows(hashes, width))
    hit = np.flatnonzero(own["maybe"][(grams & np.uint64(len(own["maybe"]) - 1)).astype(np.int64)])
    at = np.searchsorted(own["grams"], grams[hit])
    row = np.searchsorted(first, hit, "right") - 1
    real = (own["grams"][np.minimum(at, len(own["grams"]) - 1)] == grams[hit]) & (hit + width <= first[row + 1])
    hit, row = hit[real], row[real]
    for r in np.unique(row):
        of = hit[row == r]
        yield int(r), of - first[r], grams[of]


def matches(x: dict, width: int, doc: np.ndarray, place: np.ndarray, grams: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int]]:
    """(item, covered words, tiles) of the items that leak into a document of which the shared seeds are given. Items whose shared
    seeds cover too little are left out before any tile is laid."""
    own = x["widths"][width]
    once = np.unique(grams)
    low, high = np.searchsorted(own["grams"], once, "left"), np.searchsorted(own["grams"], once, "right")
    # each of the benchmark's seeds is looked at once, however often it stands in the document
    seed = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
    order = np.lexsort((own["place"][seed], own["item"][seed]))
    item, at = own["item"][seed][order], own["place"][seed][order]
    by_gram = np.argsort(grams, kind="stable")
    sorted_grams = grams[by_gram]
    bounds = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        i, words = int(item[a]), x["texts"][int(item[a])]
        least = coverage * len(words)
        if np.minimum(np.diff(at[a:b], append=at[b - 1] + width), width).sum() < least:
            continue
        own_grams = tx.mix(tx.windows(words, width))[at[a:b]]
        lo, hi = np.searchsorted(sorted_grams, own_grams, "left"), np.searchsorted(sorted_grams, own_grams, "right")
        shared = by_gram[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())]
        got = tiles(doc, words, place[shared], np.repeat(at[a:b], hi - lo), width)
        n = sum(t[2] for t in got)
        if n >= least:
            yield i, n, len(got)


def _found(x: dict, piece: pa.RecordBatch, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, covered words, tiles) of all leaks into a piece."""
    data, at = tx.as_bytes(piece.column("text"))
    hashes, first = tx.words(tx.LOWER[data], at, tx.NOT_ALNUM)[2:]
    for width in x["widths"]:
        for r, place, grams in seeds_of(x, width, hashes, first):
            for i, n, k in matches(x, width, hashes[first[r] : first[r + 1]], place, grams, coverage):
                yield r, i, n, k


def _leaks_in(index, min_match: int, coverage: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for piece in tx.pieces(batches):
            ids, rows = piece.column("doc_id").to_pylist(), []
            for r, i, n, k in _found(x, piece, coverage):
                size = len(x["texts"][i])
                rows.append((ids[r], x["ids"][i], size, n, k, n / size))
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=[c.split()[0] for c in LEAKS.split(", ")])

    return find


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows into which an item leaks; all columns stay. Rows are judged where they are, one by one, whatever
    their doc_id; null and empty texts stay."""
    for blocks, index in _blocks(benchmark, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
        docs = rows.mapInArrow(_clean_in(shared, coverage), f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
        if blocks > 1:
            docs = store.saved(docs, "clean")
            shared.destroy()
    return docs


def _clean_in(index, coverage: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches):
            good = np.ones(piece.num_rows, bool)
            for r, *_ in _found(index.value, piece, coverage):
                good[r] = False
            yield piece.select(["row"]).filter(pa.array(good))

    return keep


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document, over both whole tables."""
    read = spark.read.parquet
    return leaks(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))
