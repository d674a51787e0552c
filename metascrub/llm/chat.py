"""Chat formatting with budgeted windows and a loss mask, in built-in functions alone.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside role and text a backslash becomes ``\\b`` and each
control string (of this template and of other common ones) a backslash and its letter, so no control string is left in
them and reading back is exact. Prefix sums of turn tokens over a conversation choose windows of whole turns; each
window after the first repeats the system turn and as many of the turns before it as fit into the history budget. The
loss mask covers the texts of assistant turns, but never a repeated one, so each target counts once.

The sums are taken over ranges of turns first. They deal a conversation into blocks of some windows' tokens; a window
begins anew with each block, and a block gets the turns before it that may be its first window's history. So no task
and no row holds more of a conversation than one block, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The letters that stand for control strings after a backslash.
CONTROL = {"s": START, "e": END, "t": "<|endoftext|>", "i": "[INST]", "j": "[/INST]", "y": "<<SYS>>", "z": "<</SYS>>", "o": "<s>", "c": "</s>"}


def escape(text: Column, line: bool = False) -> Column:
    """Without control strings, and for a role (line) without a line break."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for k, v in (CONTROL | ({"n": "\n"} if line else {})).items():
        text = F.replace(text, F.lit(v), F.lit("\\" + k))
    return text


def turn_text(role: Column, text: Column) -> Column:
    """A turn as it is written."""
    return F.concat(F.lit(START), escape(role, True), F.lit("\n"), escape(text), F.lit(END + "\n"))


def unescape(text: Column) -> Column:
    for k, v in (CONTROL | {"n": "\n"}).items():
        text = F.replace(text, F.lit("\\" + k), F.lit(v))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def tokens(piece: Column) -> Column:
    """A tokenizer-free count: pieces of words of up to six letters, numbers of up to three digits, other signs."""
    return F.regexp_count(piece, F.lit(r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]")).cast("long")


RANGE = 256  #: turns whose sums are taken together
BLOCK = 16  #: windows' tokens of one block


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """conv_id, window (the ordinal of its first own turn, from 1), formatted, lead (leading turns that are repeats), loss (array of
    start and length in code points of formatted), n_tokens, over_budget.

    Turns go by turn, then role and text; a null turn comes first; null roles and texts are empty; equal rows are turns of
    their own. A null conv_id is a conversation like others. The first turn is the system turn if its role is ``system``.
    A turn larger than the room of a window has one of its own, marked over_budget. Extra columns are ignored; no rows
    give no windows."""
    none = F.lit("").cast("string")
    rows = conversations.select("conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), none).alias("c_key"), F.col("turn"), F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text"))
    head = F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"))
    rows = rows.withColumns({"head": F.char_length(head), "body": escape(F.col("text"))}).withColumn("piece", F.concat(head, F.col("body"), F.lit(END + "\n")))
    rows = rows.withColumns({"k": tokens(F.col("piece")), "c": F.char_length("piece").cast("long"), "target": F.when(F.col("role") == "assistant", F.char_length("body"))})
    # ordinals and prefix sums of tokens (p) and characters (q), each with the turn itself: in ranges, then over ranges
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(1 << 62))))
    inside = Window.partitionBy("c_key", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("c_key", "range").agg(F.count("*").alias("n"), F.sum("k").alias("p"), F.sum("c").alias("q"))
    before = Window.partitionBy("c_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c_key", "range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "npq"])
    # the system turn, a row for each conversation at most, goes to all its ranges
    least = rows.groupBy("c_key").agg(F.min(F.struct("turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"))).alias("least"))
    system = least.filter("least.role = 'system'").select("c_key", turn_text(F.col("least.role"), F.col("least.text")).alias("piece"))
    system = system.select("c_key", F.struct("piece", tokens(F.col("piece")).alias("k"), F.char_length("piece").cast("long").alias("c")).alias("s"))
    sums = sums.join(system, "c_key", "left")
    rows = rows.withColumns({"n_in": F.row_number().over(inside), "p_in": F.sum("k").over(upto), "q_in": F.sum("c").over(upto)}).join(sums, ["c_key", "range"])
    rows = rows.withColumns({"at": F.col("n_in") + F.col("n_before"), "p": F.col("p_in") + F.col("p_before"), "q": F.col("q_in") + F.col("q_before")})
    rows = rows.withColumn("sys", (F.col("at") == 1) & (F.col("role") == "system"))
    # a turn is in the block where it starts, and told to the next one if it may be history there
    size = BLOCK * max(1, budget - history)
    block = F.floor((F.col("p") - F.col("k")) / size)
    rows = rows.withColumn("opens", ~block.eqNullSafe(F.lag(block).over(inside)))  # the first turn of a block in a range brings the system turn
    later = ~F.col("sys") & (F.col("p") - F.col("k") >= (block + 1) * size - history)
    at = F.explode(F.array_compact(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.when(later, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))))
    rows = rows.select("*", at.alias("b")).select("conv_id", "c_key", "b.block", F.when(F.col("b.own") & F.col("opens"), F.col("s")).alias("s"), F.struct("at", "p", "q", "k", "c", "head", "target", "sys", "b.own", "piece").alias("t"))
    blocks = rows.groupBy("conv_id", "c_key", "block").agg(F.sort_array(F.collect_list("t")).alias("t"), F.first("s", ignorenulls=True).alias("s")).filter(F.exists("t", lambda x: x["own"]))
    blocks = blocks.withColumn("o", F.expr("size(filter(t, x -> not x.own))"))  # turns that are told only
    blocks = blocks.withColumns({"first": F.expr("o + if(t[o].sys, 1, 0)"), "room": F.expr(f"greatest(1L, {budget - history} - coalesce(s.k, 0L))")})
    # first turns of windows, as places in t: the system turn stays with the first one
    starts = """aggregate(if(size(t) > first, sequence(first, size(t) - 1), array()), named_struct('base', if(size(t) > first, t[first].p - t[first].k, 0L), 'starts', array(o)),
        (a, i) -> if(t[i].p - a.base <= room or i = first, a, named_struct('base', t[i].p - t[i].k, 'starts', concat(a.starts, array(i)))), a -> a.starts)"""
    blocks = blocks.withColumn("starts", F.expr(starts))
    win = "transform(starts, (lo, i) -> named_struct('lo', lo, 'hi', coalesce(get(starts, i + 1), size(t)), 'again', t[lo].at > 1))"
    # history: the turns before lo whose tokens fit, from the prefix sums
    near = f"filter(if(w.again and w.lo > 0, sequence(w.lo - 1, 0, -1), array()), j -> not t[j].sys and t[w.lo].p - t[w.lo].k - t[j].p + t[j].k <= {history})"
    win = f"transform({win}, w -> named_struct('lo', w.lo, 'hi', w.hi, 'from', coalesce(array_min({near}), w.lo), 'sys', if(w.again and s is not null, 1, 0)))"
    own = "slice(t, w.from + 1, w.hi - w.from)"
    shift = "if(w.sys = 1, s.c, 0L) - t[w.from].q + t[w.from].c"
    loss = f"transform(filter(slice(t, w.lo + 1, w.hi - w.lo), x -> x.target is not null), x -> named_struct('start', x.q - x.c + x.head + {shift}, 'length', x.target))"
    n = "if(w.sys = 1, s.k, 0L) + t[w.hi - 1].p - t[w.from].p + t[w.from].k"
    text = f"concat(if(w.sys = 1, s.piece, ''), concat_ws('', transform({own}, x -> x.piece)))"
    done = f"transform({win}, w -> named_struct('window', t[w.lo].at, 'formatted', {text}, 'lead', w.sys + w.lo - w.from, 'loss', {loss}, 'n_tokens', {n}))"
    out = blocks.select("conv_id", F.explode(F.expr(done)).alias("w")).select("conv_id", "w.*")
    return out.withColumn("over_budget", F.col("n_tokens") > budget)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the turns that are no repeats), targets (texts under the loss mask)."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, F.col("lead") + 1, F.size(parts) - 1 - F.col("lead"))
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    turn = lambda p: F.struct(unescape(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(F.substr(body(p), F.instr(body(p), F.lit("\n")) + 1)).alias("text"))
    masked = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return formatted.select("conv_id", "window", F.transform(parts, turn).alias("turns"), masked.alias("targets"), F.char_length("formatted").cast("long").alias("chars"))


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that speaks in control strings, read back from the formatted windows."""
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(windows(rows))
    conv = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    conv = conv.select("conv_id", F.flatten("w.turns").alias("turns"), F.concat_ws("", F.flatten("w.targets")).alias("loss"), "formatted_chars")
    told = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
