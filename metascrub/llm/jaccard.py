"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents of equal sets are one class; only
classes are joined. Tokens are ordered by how full their bucket of 2^16 counters over the whole corpus is, rarest
first; two sets that link share a token of their prefixes. The index lists of prefix tokens are read in order of
set size and skipped by position: a list is cut where the sizes leave no pair, and a block whose postings all
stand too late in their sets for the overlap that a link needs is skipped whole. A list is answered from its first
set (the pivot): each other set is joined to the pivot's group instead of to all sets of the list, so a list of m
sets gives m rows. In a group, sketches come first: counts of tokens in about size/6 ranges of hash, whose
differences sum to at most the true difference of two sets, so they only drop sets that cannot link. The rest get
their tokens, and the answers of each set come from the pivot's: overlaps with the pivot bound the overlap
of any two sets from below and above, and only pairs that the bounds leave open are counted token by token. Groups
above a size are split into blocks whose pairs of blocks are separate tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import graph, repeats, store
from metascrub.llm import text as tx

BUCKETS = 1 << 16  #: counters of token frequency, whatever the corpus
GROUP_TOKENS = 2_000_000  #: tokens of a group's sets that one task holds of each of two blocks
GROUP_SETS = 10_000  #: sketches of a group's sets, likewise


def gram_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of all rows, where each row's set starts (one more at the end), and a hash of each set."""
    _, _, hashes, first = tx.words(tx.LOWER[data], at)
    rows, length = np.arange(len(at) - 1), np.diff(first)
    grams = tx.windows(hashes, n)
    row = np.repeat(rows, length)[: len(grams)]
    inside = np.arange(len(grams)) + n <= first[row + 1]
    grams, row = grams[inside], row[inside]
    short = np.flatnonzero((length > 0) & (length < n))
    whole = np.array([tx.windows(hashes[first[r] : first[r + 1]], int(length[r]))[0] + np.uint64(length[r]) for r in short], np.uint64)
    grams, row = tx.mix(np.concatenate((grams, whole))), np.concatenate((row, short))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    head = repeats._heads(row, grams)
    grams, row = grams[head], row[head]
    at_row = np.searchsorted(row, np.arange(len(at)))
    size = np.diff(at_row)
    ids = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        ids[full] = tx.mix(np.add.reduceat(tx.mix(grams ^ tx.BASE), at_row[:-1][full]) + size[full].astype(np.uint64))
    return grams, at_row, ids


def _out(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _size_up(x: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * x // 100)


def _need(a, b, percent: int):
    """Least overlap of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def sketches(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set its numbers of tokens in 2^k ranges of hash, of which it has 4 to 8 on average; 255 stands for more."""
    size = np.diff(at)
    level = np.maximum(np.int64(4), np.floor(np.log2(np.maximum(size, 1) / 4)).astype(np.int64))
    width = 1 << level
    start = np.cumsum(width) - width
    row = np.repeat(np.arange(len(size)), size)
    spot = start[row] + (grams >> (np.uint64(64) - level[row].astype(np.uint64))).astype(np.int64)
    counts = np.minimum(np.bincount(spot, minlength=int(width.sum())), 255).astype(np.uint8)
    return [counts[s : s + w].tobytes() for s, w in zip(start, width, strict=True)]


def classes(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, set_id, size, sketch) of each row, and the counters of token frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for piece in tx.pieces(batches):
            grams, at, ids = gram_sets(*tx.as_bytes(piece.column(1)), n)
            total += np.bincount((grams & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            yield _out("count_of doc_id set_id size sketch", pa.nulls(len(ids), pa.int32()), piece.column(0), ids.view(np.int64), np.diff(at), pa.array(sketches(grams, at), pa.binary()))
        some = np.flatnonzero(total)
        yield _out("count_of doc_id set_id size sketch", some.astype(np.int32), pa.nulls(len(some), pa.int64()), np.zeros(len(some), np.int64), total[some], pa.nulls(len(some), pa.binary()))

    both = store.saved(docs.mapInArrow(run, "count_of int, doc_id long, set_id long, size long, sketch binary"), "sets")
    counts = np.zeros(BUCKETS, np.int64)
    for row in both.filter("count_of is not null").groupBy("count_of").agg(F.sum("size").alias("k")).toLocalIterator():
        counts[row["count_of"]] = row["k"]
    return both.filter("count_of is null").drop("count_of"), counts


def groups(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """(set_id, pivot): the groups of sets among which all links are."""
    load = docs.sparkSession.sparkContext.broadcast(counts)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches):
            grams, at, ids = gram_sets(*tx.as_bytes(piece.column(1)), n)
            size = np.diff(at)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((grams, load.value[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)], row))
            place = np.arange(len(grams)) - np.repeat(at[:-1], size)
            once = np.zeros(len(ids), bool)
            once[np.unique(ids, return_index=True)[1]] = True
            keep = (place < (size - _size_up(size, percent) + 1)[row]) & once[row]
            row, place, token = row[keep], place[keep], grams[order][keep]
            k = size[row]
            late = k - place < _need(k, k, percent)  # only a smaller set can still reach the overlap
            yield _out("token size set_id late", token.view(np.int64), k.astype(np.int32), ids[row].view(np.int64), late)

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the block that is open: its late postings as long as there is no early one, else its pivot alone
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        for batch in batches:
            now = [*(np.asarray(batch.column(i)).astype(np.int64) for i in range(3)), batch.column(3).to_numpy(zero_copy_only=False)]
            token, size, ids, late = (np.concatenate(x) for x in zip(kept, now, strict=True))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (percent * size[1:] > 100 * size[:-1])
            head = np.flatnonzero(new)
            block, pivot = np.cumsum(new) - 1, ids[head]
            early = np.logical_or.reduceat(~late, head)
            start = head[-1]
            if len(token) - start > 1_000_000:
                early[-1] = True  # a superset of the pairs is as good, and nothing grows without end
            got = early[block] & (np.bincount(block, ids != pivot[block]) > 0)[block]
            own, of = ids[got], pivot[block[got]]
            order = np.lexsort((own, of))
            once = repeats._heads(of[order], own[order])
            yield _out("set_id pivot", own[order][once], of[order][once])
            kept = [token[-1:], size[-1:], pivot[-1:], np.zeros(1, bool)] if early[-1] else [x[start:] for x in (token, size, ids, late)]

    lists = docs.mapInArrow(postings, "token long, size int, set_id long, late boolean").repartition("token").sortWithinPartitions("token", "size", "set_id")
    return lists.mapInArrow(skip, "set_id long, pivot long").distinct()


def overlaps(mark: np.ndarray, flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many tokens of each of the rows are marked."""
    n = at[rows + 1] - at[rows]
    place = np.repeat(at[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.add.reduceat(mark[flat[place]].astype(np.int64), np.cumsum(n) - n)


def answers(size: np.ndarray, flat: np.ndarray, at: np.ndarray, block: np.ndarray, percent: int, bases: int = 8) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in order of size, the later sets that link with it; of two blocks' sets, only those across.

    A set that a base (a set whose overlaps with all others were counted) is similar enough to link with has its
    answers derived from the base's: |x and y| is within |b and y| - |b without x| and |b and y| + |x without b|.
    Only pairs that these bounds leave open are counted; a set without such a base becomes one."""
    flat = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(int(flat.max()) + 1, bool)
    every, known = np.arange(len(size)), []
    across = block.min() != block.max()
    for x in range(len(size)):
        mine = flat[at[x] : at[x + 1]]
        near = max(known, key=lambda k: k[1][x], default=None)
        if near is None or near[1][x] < _need(size[x], near[0], percent):
            mark[mine] = True
            near = (size[x], overlaps(mark, flat, at, every))
            mark[mine] = False
            known = [*known[-bases + 1 :], near]
        y = np.arange(x + 1, np.searchsorted(size, 100 * size[x] // percent, "right"))
        y = y[block[y] != block[x]] if across else y
        if not len(y):
            continue
        need, shared = _need(size[x], size[y], percent), near[1]
        low, high = shared[y] - (near[0] - shared[x]), shared[y] + (size[x] - shared[x])
        linked, open_ = low >= need, (low < need) & (high >= need)
        if open_.any():
            mark[mine] = True
            linked[open_] = overlaps(mark, flat, at, y[open_]) >= need[open_]
            mark[mine] = False
        if linked.any():
            yield x, y[linked]


PLACED = "grp long, i int, j int, blk int, node long, rows long, size long, grps array<long>, tokens array<long>"


def links(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' classes (doc_id, set_id, size), the classes' first documents (set_id, size, node, rows), and, saved,
    (a, b, n): edges of a forest with the links' components (n null) and numbers of linked rows (b null)."""
    rows, counts = classes(docs, n)
    reps = store.saved(rows.filter("size > 0").groupBy("set_id", "size").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows"), F.first("sketch").alias("sketch")), "classes")
    rows = rows.drop("sketch")
    near = store.saved(groups(docs, counts, n, percent), "groups")
    label = near.groupBy("set_id").agg(F.min("pivot").alias("label"))
    grp = near.join(label, "set_id").groupBy("pivot").agg(F.min("label").alias("grp"))
    own = near.join(grp, "pivot").select("set_id", "grp").distinct().join(reps.select("set_id", "size", "sketch"), "set_id")
    load = own.groupBy("grp").agg(F.count("*").alias("sets")).filter("sets > 1").select("grp", F.ceil(F.col("sets") / GROUP_SETS).cast("int").alias("parts"))
    own = own.join(load, "grp").withColumn("blk", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    own = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("grp", F.least("k", "blk").alias("i"), F.greatest("k", "blk").alias("j"), "blk", "size", "set_id", "sketch")
    own = own.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "size", "set_id")
    own = own.mapInArrow(lambda batches: _by_group(batches, percent, _sifted), "set_id long, grp long").distinct().join(reps.drop("sketch"), "set_id")
    load = own.groupBy("grp").agg(F.count("*").alias("sets"), F.ceil(F.sum("size") / GROUP_TOKENS).cast("int").alias("parts")).filter("sets > 1").drop("sets")
    own = own.join(load, "grp").withColumn("blk", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    # one row for each group, then one for each pair of blocks that the set takes part in
    own = own.groupBy("set_id", "node", "rows", "size").agg(F.collect_list(F.struct("grp", "blk", "parts")).alias("places"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches):
            grams, at, ids = gram_sets(*tx.as_bytes(piece.column("text")), n)
            out = []
            for r, row in enumerate(piece.drop_columns("text").to_pylist()):
                if int(ids[r : r + 1].view(np.int64)[0]) != row["set_id"]:
                    continue  # another text with the same doc_id
                grps = sorted(p["grp"] for p in row["places"])
                for p in row["places"]:
                    for k in range(p["parts"]):
                        out.append((p["grp"], min(k, p["blk"]), max(k, p["blk"]), p["blk"], row["node"], row["rows"], row["size"], grps, grams[at[r] : at[r + 1]].view(np.int64)))
                        if len(out) == 500:
                            yield _placed(out)
                            out = []
            if out:
                yield _placed(out)

    placed = docs.join(own, docs["doc_id"] == own["node"]).drop("doc_id").mapInArrow(place, PLACED)
    found = placed.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "size", "node").mapInArrow(lambda batches: _by_group(batches, percent, _joined), "a long, b long, n long")
    return rows, reps, store.saved(found, "links")


def _by_group(batches: Iterator[pa.RecordBatch], percent: int, answer) -> Iterator[pa.RecordBatch]:
    """The answer for each run of rows with equal (grp, i, j)."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        cut = [0, *repeats._heads(*(np.asarray(batch.column(k)) for k in range(3)))[1:], batch.num_rows]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            part = batch.slice(s, e - s)
            if open_ and any(open_[0].column(k)[0] != part.column(k)[0] for k in range(3)):
                yield answer(open_, percent)
                open_ = []
            open_.append(part)
    if open_:
        yield answer(open_, percent)


def _sifted(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """The sets that may link with another of their group (of one block, or two), by their sketches' differences,
    and the least set that they may reach."""
    table = pa.Table.from_batches(parts)
    block, size, ids = (np.asarray(table.column(k).combine_chunks()) for k in (3, 4, 5))
    rows = [np.frombuffer(x, np.uint8).astype(np.int32) for x in table.column(6).to_pylist()]
    across = table.column(1)[0] != table.column(2)[0]
    width = np.array([len(x) for x in rows])
    full = np.array([x.max() == 255 for x in rows])
    at = {w: np.cumsum(width == w) - 1 for w in np.unique(width)}
    own = {w: np.stack([x for x in rows if len(x) == w]) for w in at}
    half = {w: m.reshape(len(m), -1, 2).sum(2) for w, m in own.items()}
    label, some = np.arange(len(ids)), np.zeros(len(ids), bool)
    for x in range(len(ids)):
        y = np.arange(x + 1, np.searchsorted(size, 100 * size[x] // percent, "right"))
        y = y[block[y] != block[x]] if across else y
        if not len(y):
            continue
        near = np.full(len(y), -1, np.int64)
        for w, m in ((width[x], own), (2 * width[x], half)):  # sizes of a pair differ by less than two levels
            if len(of := np.flatnonzero(width[y] == w)):
                near[of] = np.abs(m[w][at[w][y[of]]] - rows[x]).sum(1)
        y = y[(near <= size[x] + size[y] - 2 * _need(size[x], size[y], percent)) | full[x] | full[y]]
        if len(y):
            some[x] = some[y] = True
            both = np.unique(label[np.concatenate(([x], y))])
            label[np.isin(label, both)] = both[0]
    return _out("set_id grp", ids[some], ids[label[some]])


def _placed(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PLACED.split(", ")])


def _joined(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """Of one group's sets (of one block, or two): the forest of their links and each set's number of linked rows."""
    table = pa.Table.from_batches(parts)
    column = lambda k: table.column(k).combine_chunks()
    grp, block, node, rows, size = table.column(0)[0].as_py(), *(np.asarray(column(k)) for k in (3, 4, 5, 6))
    i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
    use = np.ones(len(node), bool)
    # a repeated row of documents brings its class again
    use[1:] = (node[1:] != node[:-1])
    at = np.concatenate(([0], np.cumsum(size)))
    flat = np.asarray(column(8).flatten())
    grps = column(7).to_pylist()
    if not use.all():
        flat = flat[np.repeat(use, size)]
        block, node, rows, size, grps = block[use], node[use], rows[use], size[use], [g for g, u in zip(grps, use, strict=True) if u]
        at = np.concatenate(([0], np.cumsum(size)))
    if len(node) < 2 or (i != j and block.min() == block.max()):
        return _out("a b n", *[pa.array([], pa.int64())] * 3)
    label, edges, count = np.arange(len(node)), [], np.zeros(len(node), np.int64)
    many = np.array([len(g) > 1 for g in grps])
    for x, y in answers(size, flat, at, block, percent):
        for k in np.unique(label[y][label[y] != label[x]]):
            edges.append((node[k], node[label[x]]))
            label[label == k] = label[x]
        if many[x] and many[y].any():  # a pair that meets in two groups counts in the first
            both = set(grps[x])
            y = y[[not many[k] or min(both.intersection(grps[k])) == grp for k in y]]
        count[x] += rows[y].sum()
        count[y] += rows[x]
    some = np.flatnonzero(count)
    a = [*(e[0] for e in edges), *node[some]]
    b = [*(e[1] for e in edges), *[None] * len(some)]
    return _out("a b n", pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*[None] * len(edges), *count[some]], pa.int64()))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows linked with this one) for each row.

    Two rows link when 100 * common n-grams >= percent * n-grams of both. Words are split at ASCII white space and
    lower-cased A-Z; a text of fewer than n words is one gram. Null, empty and blank texts have the empty set and
    link with nothing. Rows of equal sets link with each other, repeated rows too. Rows with a null doc_id take no part and get a
    null component. Extra columns are ignored; a table without rows gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, reps, found = links(docs.filter("doc_id is not null"), n, percent)
    comps = graph.components(found.filter("b is not null"))
    count = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    reps = reps.join(comps, "node", "left").join(count, "node", "left").select(
        "set_id", "size", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    done = rows.join(reps, ["set_id", "size"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rest = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return done.unionAll(rest)


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: distinct 3-word shingles, Jaccard similarity 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
