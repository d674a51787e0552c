"""Findings, reports, counts, names of outputs and the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metascrub.functions import paths, texts

STATUSES = ("ok", "clean", "skipped", "error")


def findings(actions: DataFrame, key: str) -> DataFrame:
    """(key, category, n)."""
    return actions.groupBy(key, "category").agg(F.sum("hits").alias("n"))


def removed_list(found: DataFrame, key: str) -> DataFrame:
    """(key, removed): texts in order of ord; a text that comes again is told once, at its first place."""
    first = found.groupBy(key, "text").agg(F.min("ord").alias("ord"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("removed"))


def status_of(removed: Column) -> Column:
    return F.when(F.size(removed) > 0, "ok").otherwise("clean")


def status_counts(results: DataFrame, spark: SparkSession) -> DataFrame:
    """(status, n_files) of the four statuses, zeros too."""
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return F.broadcast(every).join(results.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n_files"))


def saved_bytes(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status").isin("ok", "clean")).agg(F.coalesce(F.sum(F.greatest(F.col("src_size") - F.col("out_size"), F.lit(0))), F.lit(0)).alias("bytes_saved"))


def saving(results: DataFrame) -> DataFrame:
    """results with saved and pct of each file; 0 percent of an empty one."""
    saved = F.col("src_size") - F.col("out_size")
    return results.withColumn("saved", saved).withColumn("pct", F.when(F.col("src_size") == 0, F.lit(0.0)).otherwise(saved * 100.0 / F.col("src_size")))


def _common(a: Column, b: Column) -> Column:
    """Characters that two texts have in common at their start."""
    least = F.least(F.char_length(a), F.char_length(b))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.coalesce(first - 1, least)


def ranked(rows: DataFrame, key: list[str], order: str, name: str, prefix: int = 3) -> DataFrame:
    """rows with their number from 0 in each key, by order (a text). Ranges come first: what texts of a key have in common is left
    out, the next ``prefix`` characters tell the range; counts of the ranges, then numbers inside each."""
    ends = rows.groupBy(*key).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    ends = ends.select(*key, _common(F.col("_a"), F.col("_b")).alias("_same"))
    rows = rows.join(ends, key).withColumn("_range", F.substr(F.col(order), F.col("_same") + 1, F.lit(prefix))).drop("_same")
    sums = rows.groupBy(*key, "_range").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(order)).cast("long")
    return rows.withColumn("_in", inside - 1).join(sums, [*key, "_range"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_before", "_in")


def _numbers_before(places: DataFrame, taken: DataFrame, key: list[str], step: int = 1 << 16) -> DataFrame:
    """places (key, _k, ...) with _free, the k-th number from 0 that taken (key, _n) does not have. Taken numbers are sorted; the
    i-th of them, n, has n - i free ones below it and moves every place from the (n - i)-th on. Both are dealt by ranges of
    ``step`` places, with counts of the ranges before."""
    cell = taken.withColumn("_cell", F.floor(F.col("_n") / step))
    counts = cell.groupBy(*key, "_cell").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_upto", F.coalesce(before, F.lit(0))).drop("_c")
    rank = F.row_number().over(Window.partitionBy(*key, "_cell").orderBy("_n")) - 1
    moved = cell.withColumn("_i", rank).join(counts, [*key, "_cell"]).select(*key, (F.col("_n") - F.col("_i") - F.col("_upto")).alias("_k"))
    more = [c for c in places.columns if c not in key and c != "_k"]
    events = places.select(*key, "_k", F.lit(1).alias("_is"), F.struct(*more).alias("_row")).unionByName(moved.select(*key, "_k", F.lit(0).alias("_is"), F.lit(None).cast(places.select(F.struct(*more).alias("r")).schema["r"].dataType).alias("_row")))
    events = events.withColumn("_cell", F.floor(F.col("_k") / step))
    sums = events.filter("_is = 0").groupBy(*key, "_cell").agg(F.count("*").alias("_c"))
    cells = events.select(*key, "_cell").distinct().join(sums, [*key, "_cell"], "left")
    cells = cells.withColumn("_upto", F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    here = F.count(F.when(F.col("_is") == 0, 1)).over(Window.partitionBy(*key, "_cell").orderBy("_k", "_is").rowsBetween(Window.unboundedPreceding, 0))
    done = events.withColumn("_here", here).join(cells, [*key, "_cell"]).filter("_is = 1")
    return done.select(*key, "_row.*", (F.col("_k") + F.col("_here") + F.col("_upto")).alias("_free"))


def name_outputs(files: DataFrame, taken: DataFrame, suffix: str = "_clean", out_dir: str | None = None, subfolder: bool = False) -> DataFrame:
    """files (path, status) with dst: folder/stem + suffix + ext, or with _1, _2, ... the next number that neither an
    existing name (taken: path) nor a file before it (by path) has. Rows that are neither ok nor clean use no number up.

    A hot name (``image.jpg`` of all folders into one) is numbered by ranges of paths, and its free numbers are found by
    ranges of numbers, so no task sorts a whole group and no row carries the numbers that are taken."""
    where = F.lit(out_dir) if out_dir is not None else paths.folder(F.col("path"))
    where = F.concat(where, F.lit("/Clean")) if subfolder else where
    df = files.withColumns({"_dir": where, "_stem": F.concat(paths.stem(F.col("path")), F.lit(suffix)), "_ext": paths.ext(F.col("path"))})
    key = ["_dir", "_stem", "_ext"]
    head = F.concat(F.col("_dir"), F.when(F.col("_dir") == "", "").otherwise("/"), F.col("_stem"))
    num = F.regexp_extract(F.col("_t"), r"_([1-9][0-9]{0,8})(\.[^./]*)?$", 1)
    used = taken.select(F.col("path").alias("_t")).distinct().withColumns({"_n": F.when(num != "", num.cast("long")), "_e": paths.ext(F.col("_t"))})
    names = df.select(*key, head.alias("_head")).distinct()
    plain = names.join(used.select("_t"), F.concat("_head", "_ext") == F.col("_t"), "left_semi").select(*key, F.lit(0).cast("long").alias("_n"))
    before_number = F.left("_t", F.char_length("_t") - F.char_length("_e") - F.char_length(F.col("_n").cast("string")) - 1)
    numbered = names.join(used.filter("_n is not null").select(before_number.alias("_head"), F.col("_e").alias("_ext"), "_n"), ["_head", "_ext"]).select(*key, "_n")
    good = ranked(df.filter(F.col("status").isin("ok", "clean")), key, "path", "_k")
    good = _numbers_before(good, plain.unionByName(numbered).distinct(), key)
    rest = df.filter(~F.coalesce(F.col("status").isin("ok", "clean"), F.lit(False))).withColumn("_free", F.lit(0).cast("long"))
    every = good.unionByName(rest)
    dst = F.concat(head, F.when(F.col("_free") == 0, "").otherwise(F.concat(F.lit("_"), F.col("_free").cast("string"))), F.col("_ext"))
    return every.withColumn("dst", dst).drop(*key, "_free")


def name_alone(files: DataFrame, taken: DataFrame, suffix: str = "_clean", out_dir: str | None = None) -> DataFrame | None:
    """What ``name_outputs`` gives where every name stands alone: none is taken, and none comes twice. One count of the names tells; else None."""
    where = F.lit(out_dir) if out_dir is not None else paths.folder(F.col("path"))
    named = files.withColumn("dst", F.concat(where, F.when(where == "", "").otherwise("/"), paths.stem(F.col("path")), F.lit(suffix), paths.ext(F.col("path"))))
    names = named.filter(F.col("status").isin("ok", "clean")).select("dst").unionByName(taken.select(F.col("path").alias("dst")).distinct())
    return None if names.groupBy("dst").count().filter("count > 1").take(1) else named


def match_results(results: DataFrame, items: DataFrame) -> DataFrame:
    """Results with what their queued item says, by path; results of no item are left out."""
    return results.join(items, "path")


def new_paths(files: DataFrame, queued: DataFrame) -> DataFrame:
    """Distinct paths that are not in the queue."""
    return files.select("path").dropDuplicates(["path"]).join(queued.select("path"), "path", "left_anti")


def match_sizes(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """(path, src_size, out_size) where the original (path, dst, src_size) and its copy (dst, out_size) are both there."""
    return sources.join(outputs, "dst").select("path", "src_size", "out_size")


def progress(results: DataFrame) -> DataFrame:
    """How many are done and how many are not, a null status among these."""
    done = F.coalesce(F.col("status").isin("ok", "clean"), F.lit(False))
    return results.agg(F.count_if(done).alias("done"), F.count_if(~done).alias("pending"))


def unfinished(results: DataFrame) -> DataFrame:
    """What stays in the queue when finished items are cleared."""
    return results.filter(~F.coalesce(F.col("status").isin("ok", "clean"), F.lit(False)))


def summary_line(results: DataFrame) -> DataFrame:
    """(all, line): the number of results, and counts by status in order of its name, zeros left out."""
    counts = results.groupBy("status").agg(F.count("*").alias("k"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("status", "k"))), lambda x: F.concat(x["status"], F.lit(": "), x["k"].cast("string")))
    return counts.agg(F.sum("k").alias("all"), F.array_join(told, "  ").alias("line"))


def report_lines(results: DataFrame, title: str = "metascrub sanitization report") -> DataFrame:
    """(section, seq, line) of the plain-text report; write them in this order."""
    base = paths.base(F.col("path"))
    block = F.array(F.concat(F.lit("  "), base), F.concat(F.lit("      status : "), F.col("status")), F.concat(F.lit("      result : "), F.coalesce("details", F.lit("—"))), F.lit(""))
    body = results.select(F.lit(1).alias("section"), F.col("path").alias("seq"), F.posexplode(block).alias("n", "line"))
    total = summary_line(results).withColumnRenamed("line", "s")
    foot = total.select(F.lit(2).alias("section"), F.lit("").alias("seq"), F.posexplode(F.array(F.lit("-" * 62), F.concat(F.lit("Total files: "), F.coalesce("all", F.lit(0)).cast("string"), F.lit("   ("), F.col("s"), F.lit(")")), F.lit("Originals were never modified."))).alias("n", "line"))
    head = results.sparkSession.createDataFrame([(0, "", 0, title), (0, "", 1, "=" * 62), (0, "", 2, "")], "section int, seq string, n int, line string")
    return head.unionByName(body).unionByName(foot)


def summary(results: DataFrame) -> DataFrame:
    return results.withColumn("summary", texts.summary(F.col("status"), F.col("removed"), F.col("error")))
