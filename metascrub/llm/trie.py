"""The prefix trie of conversations, as a table of nodes without pointers.

A prefix of d turns is known by 128 bits: two sums over its turns of a turn's hash times an odd base to the power of its
place, modulo 2^64. Sums can be cut anywhere, so one conversation may be dealt over many tasks, and a prefix's parent is
its sum without the last turn. Distinct prefixes are counted with partial sums before any row moves; each must have one
parent and one last turn (by SHA-256), which by induction proves that no two prefixes share their bits.

Sums over subtrees are taken where there is something to sum, in nodes with several members. Such nodes are dealt to
shards by the subtree they are in; a shard gives each of its digests a slot by a minimal perfect hash, checks the digest
in the slot at each look-up, keeps counts in flat arrays by slot and adds each depth to its parents' slots, deepest first.
Nodes with more members than ``most`` are cut off: their subtrees come first, and they are a last shard of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import ordered, store
from metascrub.llm import text as tx

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD = 1 << 64
BAND = 1024  #: depths of one shard
MOST = 1024  #: members of a node whose subtree goes to one shard, at least
HEAVY = 1 << 20  #: nodes above that, at most: ``most`` grows with the rows
HEAD = 5  #: turns that a conversation can take from another one
EMPTY = bytes(16)


def steps(base: int, n: int, first: int = 0) -> np.ndarray:
    """base to the powers first, first + 1, ..., n of them."""
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = pow(base, int(first), WORD)
    return np.multiply.accumulate(out)


def numbers(column: pa.Array, width: int = 16) -> np.ndarray:
    """Binary values of one width as rows of 64-bit numbers; nulls as zeros."""
    data = b"".join(v or bytes(width) for v in column.to_pylist()) if column.null_count else tx.as_bytes(column)[0].tobytes()
    return np.frombuffer(data, "<u8").reshape(-1, width // 8)


def binary(values: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as binary values."""
    width, data = values.shape[1] * 8, np.ascontiguousarray(values).tobytes()
    offsets = np.arange(0, len(data) + 1, width, dtype=np.int32) if len(data) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


# --- prefix sums of the conversations as they are


def summed(parts: DataFrame) -> DataFrame:
    """(conv_id, part, n, sums, turn, chars) of rows in order: the place n in its part and conversation, from 1, and the sums up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, carry = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            turn = numbers(batch.column(2), 32)
            begins = np.concatenate(([0], np.flatnonzero((np.diff(conv) != 0) | (np.diff(part) != 0)) + 1, [len(conv)]))
            n, sums = np.empty(len(conv), np.int64), np.empty((len(conv), 2), np.uint64)
            for a, b in zip(begins[:-1], begins[1:]):
                if last != (conv[a], part[a]):
                    last, seen, carry = (conv[a], part[a]), 0, [np.uint64(0), np.uint64(0)]
                n[a:b] = np.arange(seen + 1, seen + 1 + b - a)
                for k, base in enumerate(BASES):
                    sums[a:b, k] = np.cumsum(turn[a:b, k] * steps(base, b - a, seen + 1), dtype=np.uint64) + carry[k]
                    carry[k] = sums[b - 1, k]
                seen += b - a
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), binary(sums), batch.column(2), batch.column(3)], names=["conv_id", "part", "n", "sums", "turn", "chars"])

    return parts.select("conv_id", "part", "turn_hash", "chars").mapInArrow(run, "conv_id long, part int, n long, sums binary, turn binary, chars long")


def before(places: DataFrame) -> DataFrame:
    """(conv_id, part, n_before, before): rows and sums of a conversation's earlier parts; parts of the shared ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, total = 0, [0, 0]
                for x in row["chunks"]:
                    out.append((row["conv_id"], x["part"], n, b"".join(v.to_bytes(8, "little") for v in total)))
                    own = numbers(pa.array([x["sums"]]))[0]
                    total = [(t + int(v) * pow(base, n, WORD)) % WORD for t, v, base in zip(total, own, BASES)]
                    n += x["n"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["conv_id", "part", "n_before", "before"])

    return places.mapInArrow(run, "conv_id long, part int, n_before long, before binary")


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, sums, n_before, before, turn, chars) of all turns, written: the place among the turns of a conversation is
    n + n_before, and its prefix sum before + B^n_before * sums."""
    none = F.lit("").cast("string")
    text, role = F.coalesce(F.col("text").cast("string"), none), F.coalesce(F.col("role").cast("string"), none)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), ordered.turn_hash(role, text).alias("turn_hash"), F.char_length(text).cast("long").alias("chars"))
    keys = ["conv_id", "turn", "role", "turn_hash"]
    parts = ordered.dealt(rows, keys, "trie")
    own = store.saved(summed(ordered.in_order(parts, keys).select("conv_id", "part", "turn_hash", "chars")), "trie-sums")
    many = ordered.shared(own, "conv_id").select("conv_id")
    chunks = own.join(F.broadcast(many), "conv_id").groupBy("conv_id", "part").agg(F.max(F.struct("n", "sums")).alias("x"))
    chunks = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "x.n", "x.sums"))).alias("chunks"))
    offsets = store.saved(before(chunks), "trie-offsets")  # two rows for each part at most, so they may be broadcast
    own = own.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return own.withColumn("n_before", F.coalesce("n_before", F.lit(0).cast("long")))


# --- conversations as they are rebuilt


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, turn, chars, last), written: a row for each prefix of each rebuilt conversation, and
    depth 0 for its empty one; last marks the whole conversation."""
    own = prefixes(conversations)
    place = (F.col("n") + F.col("n_before")).alias("place")
    first = F.when(place <= HEAD, F.struct(place, "n", "sums", "n_before", "before", "turn", "chars"))
    convs = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(first)).alias("first"), F.count("*").alias("n_own"))
    convs = store.saved(convs, "trie-convs")
    heads = convs.select(F.col("conv_id").alias("head"), F.col("first").alias("head_first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    convs = convs.withColumns({"h": h, "head": F.col("conv_id") - F.col("conv_id") % 100}).join(heads, "head", "left").withColumn("head_first", F.slice(F.coalesce("head_first", F.expr("array()").cast(dict(heads.dtypes)["head_first"])), F.lit(1), F.col("h")))
    convs = convs.withColumns({"n_head": F.size("head_first"), "cut": F.when(F.size("first") >= F.col("h"), F.get("first", F.col("h") - 1))})
    convs = convs.withColumn("length", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    mine = ["conv_id", "h", "n_head", "length", "cut", F.get("head_first", F.col("n_head") - 1).alias("top")]
    of = ["n", "sums", "n_before", "before", "turn", "chars"]
    later = own.join(convs.select(*mine), "conv_id").filter(F.col("n") + F.col("n_before") > F.col("h")).select("conv_id", "length", (F.col("n") + F.col("n_before") - F.col("h") + F.col("n_head")).alias("depth"), *of, "h", "n_head", "cut", "top")
    lead = convs.select("conv_id", "length", F.explode("head_first").alias("x")).select("conv_id", "length", F.col("x.place").alias("depth"), *[F.col(f"x.{c}") for c in of])
    rows = lead.unionByName(later, allowMissingColumns=True)
    zero = F.lit(EMPTY)
    flat = lambda c: [F.coalesce(F.col(f"{c}.n_before"), F.lit(0)).alias(f"{c}_n"), F.coalesce(F.col(f"{c}.sums"), zero).alias(f"{c}_sums"), F.coalesce(F.col(f"{c}.before"), zero).alias(f"{c}_before")]
    rows = rows.select("conv_id", "depth", (F.col("depth") == F.col("length")).alias("last"), "turn", "chars", "n_before", "sums", F.coalesce("before", zero).alias("before"), *flat("cut"), *flat("top"), F.coalesce(F.col("n_head") - F.col("h"), F.lit(0)).alias("shift"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            n = {k: np.asarray(col[k]) for k in ("depth", "n_before", "cut_n", "top_n", "shift")}
            raw = {k: numbers(col[k]) for k in ("sums", "before", "cut_sums", "cut_before", "top_sums", "top_before")}
            digest, parent = np.empty((batch.num_rows, 2), np.uint64), np.empty((batch.num_rows, 2), np.uint64)
            turn = numbers(col["turn"], 32)
            for k, base in enumerate(BASES):
                times = lambda values: raised(base, values)  # noqa: B023, E731
                whole = lambda x, at: raw[f"{x}before"][:, k] + times(n[at]) * raw[f"{x}sums"][:, k]  # noqa: B023, E731
                digest[:, k] = whole("top_", "top_n") + (whole("", "n_before") - whole("cut_", "cut_n")) * times(n["shift"])
                parent[:, k] = digest[:, k] - turn[:, k] * times(n["depth"])
            yield pa.RecordBatch.from_arrays([col["conv_id"], col["depth"], binary(digest), binary(parent), col["turn"], col["chars"], col["last"]], names=["conv_id", "depth", "digest", "parent", "turn", "chars", "last"])

    out = "conv_id long, depth long, digest binary, parent binary, turn binary, chars long, last boolean"
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("last"))
    types = {"n_before": "long", "cut_n": "long", "top_n": "long", "shift": "long", "depth": "long"}
    return store.saved(rows.withColumns({k: F.col(k).cast(t) for k, t in types.items()}).mapInArrow(run, out).unionByName(root), "trie-rebuilt")


def raised(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent, modulo 2^64; negative ones too, as the base is odd."""
    values, at = np.unique(exponents, return_inverse=True)
    return np.array([pow(base, int(v), WORD) for v in values], np.uint64)[at]


# --- nodes


def nodes(rows: DataFrame) -> DataFrame:
    """(depth, digest, parent, conv_id, n_convs, chars) of each distinct prefix. Two that shared their bits would differ in their
    parent or last turn, which ends the job with an error."""
    one = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("binary"))
    each = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), one("parent").alias("parent"), one("turn").alias("turn"))
    return each.filter(F.col("turn").isNotNull() | (F.col("depth") == 0)).drop("turn")


class Slots:
    """A minimal perfect hash of distinct digests: a bit array for each level holds those that are alone in their place, the
    others go to the next level; a slot is the number of bits before."""

    def __init__(self, keys: np.ndarray):
        self.levels, rest, base = [], keys, 0
        while len(rest) and len(self.levels) < 64:
            at = self._places(rest, 2 * len(rest), len(self.levels))
            alone = np.bincount(at, minlength=2 * len(rest)) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError("a digest stands twice in a shard")
        self.held = np.zeros((len(keys), 2), np.uint64)
        self.held[self._slots(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, size: int, level: int) -> np.ndarray:
        salt = np.array([level * int(tx.BASE) % WORD], np.uint64)
        return (tx.mix(tx.mix(keys[:, 0] + salt) ^ keys[:, 1]) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._places(keys[left], len(alone), level)
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 of those that are none of the digests, as the digest in the slot tells."""
        at = self._slots(keys)
        at[(at < 0) | (self.held[at] != keys).any(1)] = -1
        return at


def accumulate(depth: np.ndarray, digest: np.ndarray, parent: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Sums of each count over the subtrees among these nodes."""
    slots = Slots(digest)
    own, up = slots(digest), np.where(depth > 0, slots(parent), -1)
    flat = [np.zeros(len(own), np.int64) for _ in counts]
    for to, values in zip(flat, counts):
        to[own] = values
    by_depth = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, cuts):  # deepest first
        level = level[up[level] >= 0]
        for to in flat:
            np.add.at(to, up[level], to[own[level]])
    return [x[own] for x in flat]


def shards(level: DataFrame, size: int = 1 << 17) -> DataFrame:
    """(depth, digest, n_leaves, saved_tokens) of level (depth, digest, parent, top, leaves, saved): sums over subtrees. Rows of one
    top (a binary) stay together; a shard is one top or as many as have ``size`` nodes."""
    names = ["depth", "digest", "n_leaves", "saved_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            depth, digest, parent, _, leaves, saved = rows.columns
            sums = accumulate(np.asarray(depth), numbers(digest), numbers(parent), np.asarray(leaves), np.asarray(saved))
            return pa.RecordBatch.from_arrays([depth, digest, *map(pa.array, sums)], names=names)

        for batch in batches:
            tops = numbers(batch.column(3))
            cuts = (np.flatnonzero((tops[1:] != tops[:-1]).any(1)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if held and sum(x.num_rows for x in held) >= size and held[-1].column(3)[-1] != batch.column(3)[a]:
                    yield out()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield out()

    columns = level.select("depth", "digest", "parent", "top", "leaves", "saved")
    return columns.repartition("top").sortWithinPartitions("top").mapInArrow(run, "depth long, digest binary, n_leaves long, saved_tokens long")


def subtrees(known: DataFrame, rows: DataFrame, most: int, band: int) -> DataFrame:
    """(depth, digest, n_leaves, saved_tokens) of nodes with several members; known: nodes with n_children, and in alone the number of
    their children with one member, each of which ends in one leaf."""
    leaves = F.col("alone") + (F.col("n_children") == 0).cast("long")
    shared = store.saved(known.filter("n_convs > 1").select("depth", "digest", "parent", "conv_id", "n_convs", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-shared")
    heavy = shared.filter(F.col("n_convs") > most)  # rows / most at most, which is bounded
    # the top of a node: of its least member, the first prefix that isn't heavy; by bands of depth, so that no long way is one shard
    marked = rows.join(F.broadcast(heavy.select("depth", "digest", F.lit(True).alias("heavy"))), ["depth", "digest"], "left").filter("heavy is null")
    tops = marked.groupBy("conv_id").agg(F.min(F.struct("depth", "digest")).alias("first"))
    below = F.col("depth") - F.col("first.depth")
    light = shared.filter(F.col("n_convs") <= most).join(tops, "conv_id")
    light = light.select(*shared.columns, F.floor(below / band).alias("level"), (below % band == 0).alias("root"), F.col("first.digest").alias("top"))
    heavy = heavy.select("*", F.lit(-1).cast("long").alias("level"), F.lit(False).alias("root"), F.lit(EMPTY).alias("top"))
    levels = store.saved(light.unionByName(heavy), "trie-levels")
    found, roots = [], None
    for b in range(levels.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0], -2, -1):
        level = levels.filter(F.col("level") == b)
        now = level
        if roots is not None:  # each root of the level before hangs below a node of this one
            more = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            now = level.join(more, ["depth", "digest"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
        found.append(store.saved(shards(now), "trie-subtrees"))
        roots = found[-1].join(level.filter("root").select("depth", "digest", "parent"), ["depth", "digest"])
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    return done


def ends(rows: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of nodes where conversations end: rows go by node and conv_id, and the digest is taken as
    they pass, so that no list of members is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for depth, digest, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node != (depth, digest):
                    done += [(*node, sha.hexdigest())] if node else []
                    node, sha = (depth, digest), hashlib.sha256(b"%d" % conv)
                else:
                    sha.update(b",%d" % conv)
            if done:
                yield told(done)
        if node:
            yield told([(*node, sha.hexdigest())])

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.binary(), pa.string()))], names=["depth", "digest", "ends_sha256"])

    last = rows.filter("last").select("depth", "digest", "conv_id")
    return last.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "conv_id").mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def trie(conversations: DataFrame, most: int | None = None, band: int = BAND) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns go by turn (null first), then role and the hash of role and text; null roles and texts are empty; equal rows are
    turns of their own. ``c % 100`` has the sign of c. Rows with a null conv_id belong to no conversation and are left out.
    Extra columns are ignored; no conversations give no nodes, not even a root. ``most`` and ``band`` say how nodes are
    dealt, not what comes out."""
    rows = rebuilt(conversations)
    each = store.saved(nodes(rows), "trie-nodes")
    if most is None:
        most = max(MOST, (each.agg(F.sum("n_convs")).first()[0] or 0) // HEAVY)
    kids = each.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"), F.sum(F.when(F.col("n_convs") == 1, 1).otherwise(0)).alias("alone"))
    zero = F.lit(0).cast("long")
    known = each.join(kids, ["depth", "digest"], "left").withColumns({"n_children": F.coalesce("n_children", zero), "alone": F.coalesce("alone", zero)})
    known = store.saved(known, "trie-known")
    sums = subtrees(known, rows, most, band)
    up = each.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = known.join(sums, ["depth", "digest"], "left").join(ends(rows), ["depth", "digest"], "left").join(up, ["depth", "parent"], "left")
    one = F.col("n_convs") == 1
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.when(one, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), F.when(one, 0).otherwise(F.col("saved_tokens")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same on whole sequences of turns; crc32 bit by bit over the digits of an id.
ORACLE = """with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as txt, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n from conversations where conv_id is not null),
  c as (select conv_id, count(*) as n_own, conv_id - conv_id % 100 as head, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda x: x::ubigint)), lambda z, i: xor(z >> 1, 3988292384::ubigint * (z & 1))))) % 6 as h from o group by conv_id),
  k as (select c.*, least(c.h, coalesce(b.n_own, 0)) as n_head from c left join c b on b.conv_id = c.head),
  r as (select k.conv_id, o.n as depth, role, txt from k join o on o.conv_id = k.head and o.n <= k.h union all select k.conv_id, o.n - k.h + k.n_head, role, txt from k join o on o.conv_id = k.conv_id and o.n > k.h),
  s as (select conv_id, depth, txt, sha256(string_agg(length(role) || ':' || role || length(txt) || ':' || txt, '') over (partition by conv_id order by depth)) as node from r union all select conv_id, 0, '', '' from c),
  p as (select *, lag(node) over (partition by conv_id order by depth) as up, depth = max(depth) over (partition by conv_id) as ends from s),
  v as (select node, depth, min(conv_id) as conv_id, any_value(up) as up, count(*) as n_convs, (count(*) - 1) * max(length(txt)) as own, sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from p group by node, depth),
  kids as (select up as node, count(*) as n_children from v where up is not null group by up),
  below as (select distinct a.node as top, b.node from p a join p b on a.conv_id = b.conv_id and b.depth >= a.depth),
  sums as (select top as node, sum(v.own)::bigint as saved_tokens, count(*) filter (where kids.node is null) as n_leaves from below join v on v.node = below.node left join kids on kids.node = below.node group by top)
  select v.conv_id, v.depth::bigint as depth, u.conv_id as parent_conv_id, v.n_convs, coalesce(kids.n_children, 0) as n_children, n_leaves, saved_tokens, v.ends_sha256
  from v join sums on sums.node = v.node left join kids on kids.node = v.node left join v u on u.node = v.up"""
