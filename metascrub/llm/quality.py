"""Quality rules by a hashed n-gram log-likelihood ratio, in built-in functions alone.

Words and word pairs are hashed into ``buckets`` buckets each. Two multinomials with add-one smoothing are counted over
them: one over the trusted target (a bounded sample of the labelled good documents), one over every document. A
document's score is the sum of log p_target - log p_raw over its n-grams, divided by their number. The threshold is
the same for every document: the gap between histogram bins of score that costs least over the labelled samples that pass the base rules, a lost
good document counting ``weight`` times a kept bad one; its middle, and of equal gaps the lowest. Base rules (length, repetition) come first. No step shuffles texts; what is shuffled is one count for
each bucket and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
BUCKETS = 4096  #: for words, and as many for word pairs
BIN = 0.001  #: width of the bins of scores from which the threshold is read


def words(text: Column) -> Column:
    """The words between ASCII white space; none for null."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPLIT))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and wh, the words' hashes.

    For repeated windows, the windows' hashes are packed with their places into single numbers and sorted; neighbours
    that agree are compared again by whole hashes. Every step is linear or a sort, whatever a text repeats, and texts
    whose windows are all distinct leave after the first."""
    blank = F.lit(BLANKS)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_w", words(F.col("text")))
    df = df.withColumns({
        "wh": F.transform("_w", lambda w: F.xxhash64(w)),
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, blank) != ""),
    })
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_w", "_lines")
    df = df.withColumn("_win", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(slice(wh, 1, size(wh) - 2), (h, i) -> xxhash64(h, get(wh, i + 1), get(wh, i + 2))))"))
    df = df.withColumn("_bits", F.expr("length(bin(n_words))"))
    none = "cast(array() as array<bigint>)"
    df = df.withColumn("_packed", F.expr(f"if(size(_win) = size(array_distinct(_win)), {none}, sort_array(transform(_win, (h, i) -> shiftleft(h, _bits) | i)))"))
    df = df.withColumn("_near", F.expr("""transform(
        filter(_packed, (p, j) -> shiftright(p, _bits) <=> shiftright(get(_packed, j - 1), _bits) or shiftright(p, _bits) <=> shiftright(get(_packed, j + 1), _bits)),
        p -> p & (shiftleft(1L, _bits) - 1))"""))
    df = df.withColumn("_same", F.expr("sort_array(transform(_near, p -> struct(get(_win, cast(p as int)) as h, p as p)))"))
    df = df.withColumn("_at", F.expr("sort_array(transform(filter(_same, (s, j) -> s.h <=> get(_same, j - 1).h or s.h <=> get(_same, j + 1).h), s -> s.p))"))
    # the id adds nothing: it keeps filters above from being pushed down, which would copy the steps into one another
    df = df.withColumn("n_repeat_words", F.expr("aggregate(transform(_at, (p, j) -> least(3L, coalesce(get(_at, j + 1) - p, 3L))), 0L, (a, x) -> a + x) + 0 * monotonically_increasing_id()"))
    return df.drop("_win", "_bits", "_packed", "_near", "_same", "_at")


def base_failed(least_words: int, most_repeated: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def grams(buckets: int) -> Column:
    """Buckets of a text's words and word pairs, from wh."""
    return F.expr(f"concat(transform(wh, h -> cast(pmod(h, {buckets}) as int)), if(size(wh) < 2, cast(array() as array<int>), transform(slice(wh, 1, size(wh) - 1), (h, i) -> {buckets} + cast(pmod(xxhash64(h, get(wh, i + 1)), {buckets}) as int))))")


def labelled(labels: DataFrame, good: bool, most: int) -> DataFrame:
    """(doc_id, _good) of at most ``most`` documents labelled good and not toxic, or bad: those with the least hash."""
    rule = "quality = 1 and coalesce(toxic, 0) = 0" if good else "quality = 0"
    ids = labels.filter(rule).filter("doc_id is not null").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("_good", F.lit(good))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, buckets: int = BUCKETS, weight: float = 10.0, least_words: int = 50, most_repeated: int = 50) -> tuple[list[float], float]:
    """The log-likelihood ratio of each bucket, and the threshold. Without a trusted document all ratios are 0 and the threshold is 0."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labelled(labels, True, most).unionAll(labelled(labels, False, most)).groupBy("doc_id").agg(F.min("_good").alias("_good"))
    known = F.broadcast(known)  # at most 2 * most ids
    hashed = lambda df: df.withColumn("wh", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).withColumn("g", grams(buckets))
    marked = hashed(docs.join(known, "doc_id", "left")).select(F.explode_outer("g").alias("g"), "_good")  # explode alone brings a filter on g, which is pushed down and makes each gram hash its whole text
    raw, own = [0] * (2 * buckets), [0] * (2 * buckets)
    for r in marked.groupBy("g").agg(F.count("*").alias("raw"), F.count_if("_good").alias("own")).collect():  # 2 * buckets rows at most
        if r["g"] is not None:
            raw[r["g"]], own[r["g"]] = r["raw"], r["own"]
    if not sum(own):
        return [0.0] * (2 * buckets), 0.0
    ratio = []
    for half in (slice(0, buckets), slice(buckets, None)):
        a, b = sum(own[half]) + buckets, sum(raw[half]) + buckets
        ratio += [math.log((x + 1) / a) - math.log((y + 1) / b) for x, y in zip(own[half], raw[half], strict=True)]
    tried = base_counts(docs.join(known, "doc_id")).withColumn("_failed", base_failed(least_words, most_repeated)).withColumn("g", grams(buckets))
    tried = tried.select(F.floor(score(ratio) / BIN).alias("k"), (F.col("_good") & ~F.col("_failed")).alias("good"), (~F.col("_good") & ~F.col("_failed")).alias("bad"))
    bins = tried.groupBy("k").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad")).orderBy("k").collect()  # as many as the range of scores has bins
    cost, best, edge = sum(r["bad"] for r in bins), (math.inf, 0.0), None
    for r in bins:
        # any edge from the bin before to this one costs the same: the middle
        best = min(best, (cost, (r["k"] if edge is None else (edge + r["k"]) / 2) * BIN))
        cost, edge = cost + weight * r["good"] - r["bad"], r["k"] + 1
    return ratio, best[1]


def score(ratio: list[float]) -> Column:
    """Mean log-likelihood ratio of the n-grams g; 0 without any."""
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded into a constant
    total = F.aggregate("g", F.lit(0.0), lambda a, g: a + F.get(table, g))
    return F.when(F.size("g") > 0, total / F.size("g")).otherwise(F.lit(0.0))


def judge(docs: DataFrame, ratio: list[float], threshold: float, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of each row.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them in repeated windows. A null,
    empty or blank text has no words and fails. Rows are judged one by one: repeated rows get equal results, a null doc_id is
    kept as it is, extra columns are ignored, an empty table gives none."""
    df = base_counts(docs.select("doc_id", F.col("text").cast("string").alias("text"))).withColumn("g", grams(len(ratio) // 2)).withColumn("score", score(ratio))
    df = df.withColumn("base_failed", base_failed(least_words, most_repeated))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document, with the labelled good documents as target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
