"""Repair of the structure of conversations by the cheapest edits, with Four-Russians block tables.

A conversation is repaired if its role initials are ``(s?(ua)+)?``. The state between two turns says what may follow; for
each state there is the least cost of all that still has to come. Less its minimum, such a vector of costs is one of a
few, so the step over any block of BLOCK turns is a table look-up: vector and block give the vector before the block and
what to add. The tables are filled once by composing the step over one turn. Blocks are looked up from the last to the
first, as costs to come are what makes ties safe: the edit that comes first decides, and of the cheapest ones the one
whose initial is least in ASCII is taken, which also tells the next state. A block is expanded backwards, from the vector
behind it to those inside, when its edits are traced; expansions are kept and used again.

A conversation may be in several parts. Each part of it then tells, for every vector behind it, the one before it and the
state to which each state leads; these tables, a few hundred numbers for each part, are chained over the parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascrub.llm import ordered, store

#: What edits cost, and what a truncated turn costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 3  #: turns of a block
#: States: nothing yet; behind the system turn; behind a user turn; behind an assistant turn. The role that an edit makes there.
START, SYSTEM, USER, ASSISTANT = range(4)
MAKES = (USER, USER, ASSISTANT, USER)
LETTER = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
#: Symbols: of a turn that stays or goes its initial (s, u, a, other) and whether it is truncated; and one for those that must go.
MUST_GO, SYMBOLS = 8, 9
ROLES = {"s": "system", "u": "user", "a": "assistant"}
FAR = 1 << 20  #: more than any difference between the costs of two states


def kept(state: int, symbol: int) -> int | None:
    """The state behind a turn that is kept, if it may be."""
    made = symbol // 2 + 1  # s, u, a as states
    fits = made == MAKES[state] or made == SYSTEM and state == START
    return made if symbol < MUST_GO and fits else None


def step(ahead: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to come before a turn, from those behind it; turns may be inserted before it."""
    extra = TRUNCATED if symbol < MUST_GO and symbol % 2 else 0
    out = []
    for state in range(4):
        ways = [DELETE + ahead[state]]
        if symbol < MUST_GO:
            ways.append(REROLE + extra + ahead[MAKES[state]])
        if (to := kept(state, symbol)) is not None:
            ways.append(KEEP + extra + ahead[to])
        out.append(min(ways))
    return inserted(out)


def inserted(costs: list[int]) -> tuple[int, ...]:
    """With turns inserted first where that is cheaper."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[MAKES[state]]) for state, c in enumerate(costs)]
    return tuple(costs)


END = inserted([0, FAR, FAR, 0])  #: behind the last turn


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]  #: all that can occur, less their minimum; the first is END
    one: np.ndarray  #: vector and symbol: vector before
    one_more: np.ndarray  #: what to add
    block: np.ndarray  #: vector and block: vector before; a block is its symbols as digits, the first turn's the highest
    block_more: np.ndarray


@cache
def tables() -> Tables:
    """The step over one turn for all vectors that can occur, composed to blocks."""
    vectors, known, one, more = [END], {END: 0}, [], []
    for v in vectors:  # grows while it is walked
        one.append([])
        more.append([])
        for symbol in range(SYMBOLS):
            before = step(v, symbol)
            least = min(before)
            before = tuple(c - least for c in before)
            if before not in known:
                known[before] = len(vectors)
                vectors.append(before)
            one[-1].append(known[before])
            more[-1].append(least)
    one, more = np.array(one), np.array(more)
    block, block_more = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
    for _ in range(BLOCK):  # one turn more before the block
        block, block_more = one[block].swapaxes(1, 2).reshape(len(vectors), -1), (block_more[:, :, None] + more[block]).swapaxes(1, 2).reshape(len(vectors), -1)
    return Tables(vectors, one, more, block, block_more)


def blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of whole blocks, and the turns left over before them."""
    rest = len(symbols) % BLOCK
    digits = symbols[rest:].reshape(-1, BLOCK).astype(np.int64)
    return digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1)), symbols[:rest]


def ahead(symbols: np.ndarray, vector):
    """The vectors behind each block (after them, behind each turn left over), from the last to the first, and what is added up;
    vector may be an array of several."""
    t, (numbers, rest) = tables(), blocks(symbols)
    behind, cost = [], 0
    for number in numbers[::-1].tolist():
        behind.append(vector)
        cost, vector = cost + t.block_more[vector, number], t.block[vector, number]
    for symbol in rest[::-1].tolist():
        behind.append(vector)
        cost, vector = cost + t.one_more[vector, symbol], t.one[vector, symbol]
    return behind, vector, cost


@cache
def expanded(vector: int, symbols: tuple[int, ...], state: int) -> tuple[tuple[tuple[str, str], ...], int]:
    """For each turn of a block its edits' initials, the roles' initials that they make ('-' for none), and the state behind the
    block: the vectors inside are found backwards, then the edits forwards."""
    t = tables()
    inside = [vector]
    for symbol in symbols[::-1]:
        inside.append(int(t.one[inside[-1], symbol]))
    out = []
    for symbol, behind in zip(symbols, inside[-2::-1]):
        costs, extra = t.vectors[behind], TRUNCATED if symbol < MUST_GO and symbol % 2 else 0
        before, edits, made = step(costs, symbol), "", ""
        while True:
            left, to = before[state], kept(state, symbol)
            if left == DELETE + costs[state]:
                edits, made = edits + "D", made + "-"
                break
            if left == INSERT + before[MAKES[state]]:
                state = MAKES[state]
                edits, made = edits + "I", made + LETTER[state]
            else:
                state, edit = (to, "K") if to is not None and left == KEEP + extra + costs[to] else (MAKES[state], "R")
                edits, made = edits + edit, made + LETTER[state]
                break
        out.append((edits, made))
    return tuple(out), state


def traced(symbols: np.ndarray, vector: int, state: int) -> tuple[list[tuple[str, str]], int]:
    """Edits and roles of each turn, and the state behind the last one."""
    behind, _, _ = ahead(symbols, vector)
    rest = len(symbols) % BLOCK
    cuts = [*range(rest), *range(rest, len(symbols), BLOCK), len(symbols)]
    out: list[tuple[str, str]] = []
    for a, b, v in zip(cuts, cuts[1:], behind[::-1]):
        edits, state = expanded(int(v), tuple(symbols[a:b].tolist()), state)
        out += edits
    return out, state


def finish(state: int) -> tuple[str, str]:
    """Insertions behind the last turn."""
    edits, made = "", ""
    while END[state]:
        state = MAKES[state]
        edits, made = edits + "I", made + LETTER[state]
    return edits, made


# --- faults


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): what a poor crawl does, by the checksum of conv_id:turn modulo 20: 0 drops the row, 1 empties its
    text, 2 takes its ``.!?`` away, 3 writes it twice, 4 makes it a user's. A null is one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind")).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


KEYS = ["conv_id", "turn", "role", "turn_hash"]


def keyed(rows: DataFrame) -> DataFrame:
    """rows with turn_hash, null roles and texts as one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("turn_hash", F.substring(ordered.turn_hash(F.col("role"), F.col("text")), 1, 16))


def same(a: str, b: str, *keys: str) -> Column:
    """A join condition in which nulls are equal."""
    out = F.col(f"{a}.{keys[0]}").eqNullSafe(F.col(f"{b}.{keys[0]}"))
    for k in keys[1:]:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def faults(rows: DataFrame) -> DataFrame:
    """(KEYS, n, blank, first, truncated) of distinct turns: how often each stands there; of equal ones only the first copy of the
    first turn is no duplicate. No text is moved."""
    seen = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    turns = keyed(rows).select(*KEYS, (seen == "").alias("blank"), (~F.substr(seen, F.length(seen), F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    turns = store.saved(turns.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "repair-turns")
    first = turns.filter("not blank").groupBy("conv_id", "role", "turn_hash").agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn")).alias("least"))
    found = turns.alias("t").join(first.alias("f"), same("t", "f", "conv_id", "role", "turn_hash"), "left")
    return found.select("t.*", (~F.col("blank") & F.col("t.turn").eqNullSafe(F.col("f.least.turn"))).alias("first"))


# --- edits


ROW = {"conv_id": pa.int64(), "part": pa.int32(), "turn": pa.int64(), "role": pa.string(), "turn_hash": pa.binary(), "n": pa.int64(), "blank": pa.bool_(), "truncated": pa.bool_(), "first": pa.bool_()}
ROW_DDL = "conv_id long, part int, turn long, role string, turn_hash binary, n long, blank boolean, truncated boolean, first boolean"


def symbols_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all copies, and where each row's copies begin (one more at the end)."""
    initial = np.array([{"s": 0, "u": 1, "a": 2}.get(r[:1], 3) for r in rows.column("role").to_pylist()], np.int64)
    free = np.asarray(rows.column("first").to_numpy(zero_copy_only=False), bool)
    truncated = np.asarray(rows.column("truncated").to_numpy(zero_copy_only=False), np.int64)
    n = np.asarray(rows.column("n"))
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.full(at[-1], MUST_GO, np.uint8)
    out[at[:-1][free]] = (initial * 2 + truncated)[free]
    return out, at


def begins(rows: pa.RecordBatch) -> np.ndarray:
    """Where a conversation or part begins that the row before is not in, but for the first row."""
    conv, part = rows.column("conv_id"), np.asarray(rows.column("part"))
    none, conv = np.asarray(conv.is_null().to_numpy(zero_copy_only=False), bool), np.asarray(conv.fill_null(0))
    return np.flatnonzero((conv[1:] != conv[:-1]) | (none[1:] != none[:-1]) | (part[1:] != part[:-1])) + 1


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut where conversations or parts begin; each part holds a bounded number of rows."""
    held: list[pa.RecordBatch] = []
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = begins(batch).tolist()
        if held and len(begins(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0])):
            cuts.insert(0, 0)
        if cuts:
            if cuts[-1]:
                held.append(batch.slice(0, cuts[-1]))
            yield joined()
            held.clear()
        held.append(batch.slice(cuts[-1] if cuts else 0))
    if held:
        yield joined()


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Rows of whole conversations and parts, their symbols, where each row's copies begin, and first and end row of each conversation."""
    for rows in whole(batches):
        cuts = begins(rows).tolist()
        yield rows, *symbols_of(rows), list(zip([0, *cuts], [*cuts, rows.num_rows]))


def summaries(parts: DataFrame) -> DataFrame:
    """(conv_id, part, before, leads) of parts of conversations: for each vector behind the part the one before it, and for each
    vector and state the state behind the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(tables().vectors))
        for rows, all_symbols, at, each in conversations_of(batches):
            for first, end in each:
                symbols = all_symbols[at[first] : at[end]]
                behind, before, _ = ahead(symbols, every)
                state = np.tile(np.arange(4), (len(every), 1))
                rest = len(symbols) % BLOCK
                cuts = [*range(rest), *range(rest, len(symbols), BLOCK), len(symbols)]
                for a, b, v in zip(cuts, cuts[1:], behind[::-1]):
                    block = tuple(symbols[a:b].tolist())
                    state = np.array([[expanded(x, block, s)[1] for s in row] for x, row in zip(np.asarray(v).tolist(), state.tolist())])
                yield pa.RecordBatch.from_arrays([rows.column("conv_id")[first : first + 1], rows.column("part")[first : first + 1], pa.array([np.asarray(before).tolist()], pa.list_(pa.int32())), pa.array([state.ravel().tolist()], pa.list_(pa.int32()))], names=["conv_id", "part", "before", "leads"])

    return parts.select(*ROW).mapInArrow(run, "conv_id long, part int, before array<int>, leads array<int>")


def chained(summed: DataFrame) -> DataFrame:
    """(conv_id, part, vector, state, ends) of all parts of the conversations that are in several."""
    every = F.sort_array(F.collect_list(F.struct("part", "before", "leads"))).alias("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vectors, state = [0], START
                for p in parts[:0:-1]:
                    vectors.append(p["before"][vectors[-1]])
                for p, v in zip(parts, vectors[::-1]):
                    out.append((conv, p["part"], v, state, p is parts[-1]))
                    state = p["leads"][4 * v + state]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], names=["conv_id", "part", "vector", "state", "ends"])

    return summed.groupBy("conv_id").agg(every).mapInArrow(run, "conv_id long, part int, vector int, state int, ends boolean")


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turn, role, turn_hash, n, blank, truncated, first, edits, made), written: a row for each distinct turn, with the
    initials of the cheapest edits (K keep, R rerole, D delete, I insert before) of its n copies, and the initial of the role
    that each makes ('-': none). By part, turn, role and turn_hash they are in order; insertions behind the last turn are
    told with it. Of edits that cost the same, those come out whose initials are least in ASCII."""
    parts = ordered.dealt(faults(rows), KEYS, "repair")
    split = parts.select("conv_id", "part").distinct().groupBy("conv_id").agg(F.count("*").alias("k")).filter("k > 1").select("conv_id")
    split = store.saved(split, "repair-split")  # as many as there are parts at most, so they may be broadcast
    pieces = parts.alias("p").join(F.broadcast(split).alias("s"), same("p", "s", "conv_id"), "left_semi")
    known = store.saved(chained(store.saved(summaries(ordered.in_order(pieces, KEYS)), "repair-summaries")), "repair-chained")
    known = F.broadcast(known.select("conv_id", "part", F.struct("vector", "state", "ends").alias("place")))  # two rows for each part at most
    placed = parts.alias("p").join(known.alias("k"), same("p", "k", "conv_id", "part"), "left").select("p.*", "k.place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, symbols, at, each in conversations_of(batches):
            places = rows.column("place").take(pa.array([a for a, _ in each])).to_pylist()
            copies, out = at.tolist(), []
            for (first, end), place in zip(each, places):
                place = place or {"vector": 0, "state": START, "ends": True}
                told, state = traced(symbols[copies[first] : copies[end]], place["vector"], place["state"])
                if place["ends"]:
                    told[-1] = tuple(a + b for a, b in zip(told[-1], finish(state)))
                out += told
            if len(out) != rows.num_rows:  # some turns have copies
                out = [tuple("".join(x[k] for x in out[a:b]) for k in range(2)) for a, b in zip(copies, copies[1:])]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ROW), *(pa.array([x[k] for x in out], pa.string()) for k in range(2))], names=[*ROW, "edits", "made"])

    done = ordered.in_order(placed, KEYS).select(*ROW, "place").mapInArrow(run, f"{ROW_DDL}, edits string, made string")
    return store.saved(done, "repair-edits")


def with_texts(found: DataFrame, rows: DataFrame) -> DataFrame:
    """found (edits) with text: of turns that stay; texts that go are not moved by the join's other side."""
    texts = keyed(rows).groupBy(*KEYS).agg(F.first("text").alias("text"))
    stay = F.col("edits").rlike("[KR]")
    own = found.filter(stay).alias("e").join(texts.alias("t"), same("e", "t", *KEYS)).select("e.*", "t.text")
    return own.unionByName(found.filter(~stay).withColumn("text", F.lit(None).cast("string")))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turn, place, edit, role, text): the turns of the repaired conversations, in order by part, turn, the old role,
    turn_hash and place, which are told too; inserted turns are empty.

    Turns go by turn (null first), then role and the hash of role and text. Null roles and texts are one space; a null
    conv_id is a conversation like others. Extra columns are ignored. A conversation whose turns all go has no rows."""
    full = with_texts(edits(rows), rows)
    each = F.posexplode(F.expr("filter(transform(sequence(1, length(edits)), i -> named_struct('edit', substr(edits, i, 1), 'made', substr(made, i, 1))), x -> x.edit != 'D')")).alias("place", "x")
    role = F.col("old_role")
    for k, v in ROLES.items():
        role = F.when((F.col("x.edit") != "K") & (F.col("x.made") == k), v).otherwise(role)
    out = full.select("conv_id", "part", "turn", F.col("role").alias("old_role"), "turn_hash", "text", each)
    return out.select("conv_id", "part", "turn", "old_role", "turn_hash", "place", F.col("x.edit").alias("edit"), role.alias("role"), F.when(F.col("x.edit") == "I", "").otherwise(F.col("text")).alias("text"))


def reports(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, taken as its rows
    pass in order; only the audit is held, one character for each edit. Texts are moved once: they follow the row that
    tells what becomes of them."""
    found = edits(rows).select(*KEYS, F.lit(0).alias("of"), "n", "blank", "truncated", "first", "edits", "made", F.lit(None).cast("string").alias("text"))
    full = found.unionByName(keyed(rows).select(*KEYS, F.lit(1).alias("of"), "text"), allowMissingColumns=True)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [*[pa.int64()] * 7, pa.string(), pa.string()]

    class Open:
        def __init__(self, conv):
            self.conv, self.audit, self.sha, self.begun = conv, [], hashlib.sha256(), False
            self.least = self.most = self.turn = None
            self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
            self.initial = None

        def add(self, r: dict) -> None:
            turn, n, initial = r["turn"], r["n"], r["role"][:1]
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.distinct += turn != self.most
                self.most = turn
            self.blank += n * r["blank"]
            self.duplicate += 0 if r["blank"] else n - r["first"]
            self.truncated += r["first"] and r["truncated"]
            self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
            self.initial = initial
            self.audit.append(r["edits"])
            costs = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
            for edit, made in zip(r["edits"], r["made"]):
                self.cost += costs[edit]
                if edit in "KR":
                    self.cost += TRUNCATED * r["truncated"]
                if edit != "D":
                    role = r["role"] if edit == "K" else ROLES[made]
                    text = "" if edit == "I" else r["text"]
                    self.sha.update(f"{chr(10) * self.begun}{role}:{text}".encode())
                    self.begun = True

        def done(self) -> tuple:
            gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
            return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn = None, None  # the conversation and the turn that are open
        told = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["of"]:
                    turn["text"] = r["text"]
                    continue
                if turn:
                    now.add(turn)
                turn = r
                if now is None or now.conv != r["conv_id"]:
                    done += [now.done()] if now else []
                    now = Open(r["conv_id"])
            if done:
                yield told(done)
        if turn:
            now.add(turn)
            yield told([now.done()])

    order = [F.col(k).asc_nulls_first() for k in (*KEYS, "of")]
    columns = ["conv_id", "turn", "role", "of", "n", "blank", "truncated", "first", "edits", "made", "text"]
    return full.repartition("conv_id").sortWithinPartitions(*order).select(*columns).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every damaged conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = reports(damage(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.alias("c").join(found.alias("f"), same("c", "f", "conv_id"), "left")
    numbers = [F.coalesce(F.col(f"f.{n}"), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("c.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by costs to come, turn by turn from the last one, as structs (c cost, a audit, t lines), which SQL compares in this order."""
    crc = """xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::ubigint)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda x: x::ubigint)), lambda z, i: xor(z >> 1, 3988292384::ubigint * (z & 1)))))"""
    way = lambda v, cost, edit, line=None: f"{{'c': {v}.c + {cost}, 'a': '{edit}' || {v}.a, 't': " + (f"list_prepend({line}, {v}.t)" if line else f"{v}.t") + "}"
    least = lambda *ways: ways[0] if len(ways) == 1 else f"list_sort([{', '.join(ways)}])[1]"
    name = {USER: "user", ASSISTANT: "assistant"}
    keeps = {START: [("s", SYSTEM), ("u", USER)], SYSTEM: [("u", USER)], USER: [("a", ASSISTANT)], ASSISTANT: [("u", USER)]}
    truncated = f"(case when cut then {TRUNCATED} else 0 end)"
    js = []
    for q in range(4):
        drop, to = way(f"v{q}", DELETE, "D"), MAKES[q]
        rerole = way(f"v{to}", f"{REROLE} + {truncated}", "R", f"'{name[to]}:' || txt")
        keep = " ".join(f"when ini = '{i}' then {way(f'v{k}', truncated, 'K', chr(34) + 'role' + chr(34) + chr(32) + '|| ' + repr(':') + ' || txt')}" for i, k in keeps[q])
        js.append(f"case when must then {drop} else {least(drop, rerole, f'case {keep} else {drop} end')} end as j{q}")
    insert = lambda v, to: way(v, INSERT, "I", f"'{name[to]}:'")
    first = f"{least('j2', insert('j3', ASSISTANT))} as v2, {least('j3', insert('j2', USER))} as v3"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""with recursive d as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end as txt, unnest(case kind when 3 then [0, 1] else [0] end) as copy
    from (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as txt, {crc} % 20 as kind from conversations) where kind <> 0),
  n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, txt) as i, right(rtrim(txt, {blanks}), 1) as last, left(role, 1) as ini from d),
  f as (select *, last = '' as blank, row_number() over (partition by conv_id, role, txt order by i) > 1 as again, last not in ('.', '!', '?') as cut, lag(ini) over (partition by conv_id order by i) || ini not in ('su', 'ua', 'au') as illegal from n),
  g as (select *, blank or again as must from f),
  r as (select conv_id, max(i) + 1 as i, {{'c': 0, 'a': '', 't': []::varchar[]}} as v0, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} as v1, {{'c': 3, 'a': 'I', 't': ['assistant:']}} as v2, {{'c': 0, 'a': '', 't': []::varchar[]}} as v3 from g group by conv_id
    union all select conv_id, i, {least('j0', insert('v2', USER))}, {least('j1', insert('v2', USER))}, v2, v3 from (select conv_id, i, j0, j1, {first} from (select g.conv_id, g.i, {', '.join(js)} from r join g on g.conv_id is not distinct from r.conv_id and g.i = r.i - 1))),
  s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate, count(*) filter (where cut and not must) as truncated, count(*) filter (where illegal) as illegal from g group by conv_id)
  select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(v0.c, 0)::bigint as cost, coalesce(v0.a, '') as audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) as repaired_sha256
  from (select distinct conv_id from conversations) c left join s on s.conv_id is not distinct from c.conv_id left join r on r.conv_id is not distinct from c.conv_id and r.i = 1"""


ORACLE = _oracle()
