"""The drop box: files or events that arrive are cleaned, reported and counted while others wait.

``DropBox`` does the whole of it, batch by batch: paths that were seen before go, files are cleaned, named, written and reported. What a
batch leaves stands under its number, and a batch that is run again finds it there and changes nothing. ``queue`` and
``requeue`` hold the commands of its users."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from metascrub.operators import clean, reports, rewrite
from metascrub.sources import copies, stores


def arrivals(spark: SparkSession, folder: str, schema: StructType | str | None = None, kind: str = "binaryFile", per_trigger: int = 1000) -> DataFrame:
    """A stream of new files (kind binaryFile), or of rows of new Parquet files; a file is seen once."""
    own = "path string, modificationTime timestamp, length long, content binary" if kind == "binaryFile" else None
    return spark.readStream.format(kind).option("maxFilesPerTrigger", per_trigger).schema(schema or own).load(folder)


def clean_images(stream: DataFrame) -> DataFrame:
    return clean.strip_images(stream, key="path")


def scrub(stream: DataFrame, column: str) -> DataFrame:
    return rewrite.scrub_markup(stream, column)


def once(stream: DataFrame, key: str = "path") -> DataFrame:
    """Each key once. State holds every key that was seen, as no event time bounds it; ``Ledger`` does the same without state."""
    return stream.dropDuplicates([key])


class Ledger:
    """Keys that were seen, in a table beside the stream, so that its state does not grow: ``fresh`` of a batch leaves out what earlier
    batches have and writes the rest under the batch's number, which makes it safe to run again. A batch's files are sorted by
    the hash of the key, so a batch reads the ranges that it may meet. ``compact`` puts what is there in one table."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "path"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = f"h long, `{key}` string"

    def _parts(self) -> tuple[int, list[int]]:
        """The batch up to which one table holds all, or -1, and the batches after it."""
        store, at = stores.opened(self.folder)
        names = [x.path.rstrip("/") for x in store.get_file_info(pafs.FileSelector(at, allow_not_found=True))]
        ready = [n.rsplit("/", 1)[-1] for n in names if store.get_file_info(f"{n}/_SUCCESS").type == pafs.FileType.File]
        number = lambda kind: [int(n.split("=")[1]) for n in ready if n.startswith(f"{kind}=")]
        upto = max(number("upto"), default=-1)
        return upto, sorted(b for b in number("batch") if b > upto)

    def _read(self, upto: int, batches: list[int]) -> DataFrame | None:
        folders = [f"{self.folder}/upto={upto}"] * (upto >= 0) + [f"{self.folder}/batch={b}" for b in batches]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else None

    def fresh(self, rows: DataFrame, batch: int) -> DataFrame:
        """The keys (h, key) of rows that no earlier batch has, each once, written."""
        upto, batches = self._parts()
        if batch > upto:  # else it is in the table of all, and was finished
            new = rows.filter(F.col(self.key).isNotNull()).select(F.xxhash64(self.key).alias("h"), self.key).dropDuplicates([self.key])
            seen = self._read(upto, [b for b in batches if b < batch])
            if seen is not None:
                new = new.join(seen, ["h", self.key], "left_anti")
            new.repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={batch}")

    def all(self) -> DataFrame:
        return self._read(*self._parts()) or self.spark.createDataFrame([], self.schema)

    def compact(self, below: int) -> None:
        """One table of all batches below ``below``; the folders that it replaces go after it is whole, so a stop in between harms nothing."""
        upto, batches = self._parts()
        batches = [b for b in batches if b < below]
        if not batches:
            return
        self._read(upto, batches).repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(f"{self.folder}/upto={batches[-1]}")
        store, at = stores.opened(self.folder)
        for name in [f"upto={upto}"] * (upto >= 0) + [f"batch={b}" for b in batches]:
            store.delete_dir(f"{at}/{name}")


#: Settings of a stream of files: a task lists and opens many small ones, where Spark would start a task for each file or few.
SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.files.openCostInBytes": "65536"}


class DropBox:
    """A folder that is watched, and what comes of it: copies under their names in ``out``; below ``book`` the ledger of paths, the names
    given, the reports and the counts.

    All formats go through ``operators.clean.clean_files``. The numbers of names go on over batches. Originals are never touched."""

    def __init__(self, spark: SparkSession, out: str, book: str, options: clean.Options = clean.Options(), compact: int = 100):
        self.spark, self.out, self.book, self.options, self.compact = spark, out.rstrip("/"), book.rstrip("/"), options, compact
        self.ledger = Ledger(spark, f"{self.book}/seen")

    def _table(self, name: str, schema: str) -> DataFrame:
        """What earlier batches wrote; empty before the first one."""
        store, at = stores.opened(f"{self.book}/{name}")
        if store.get_file_info(at).type == pafs.FileType.NotFound:
            return self.spark.createDataFrame([], schema + ", batch long")
        return self.spark.read.schema(schema + ", batch long").parquet(f"{self.book}/{name}")

    def reports(self) -> DataFrame:
        """(path, dst, status, removed, error, src_size, out_size, batch) of all files."""
        return self._table("reports", "path string, dst string, status string, removed array<string>, error string, src_size long, out_size long")

    def counts(self) -> DataFrame:
        """(status, n_files, bytes_saved)."""
        return counts(self.reports())

    def batch(self, files: DataFrame, number: int) -> None:
        """One batch of files (path, content); each step overwrites what it left under the batch's number before."""
        self._settle(clean.clean_files(files, self.options), number)

    def _settle(self, cleaned: DataFrame, number: int) -> None:
        """One batch of what ``clean_files`` gives. It is written first, so that files are read once; later steps see paths and sizes, and
        contents are read again as they are copied."""
        at = f"{self.book}/cleaned/batch={number}"
        cleaned.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(at)
        done = self.spark.read.schema(cleaned.schema.add("row", "long")).parquet(at)
        new = self.ledger.fresh(done, number).select("path")
        mine = done.drop("new_content").dropDuplicates(["path"]).join(new, "path", "left_semi")
        earlier = self.reports().filter((F.col("batch") < number) & F.col("status").isin("ok", "clean")).select(F.col("dst").alias("path"))
        named = reports.name_alone(mine, earlier, self.options.suffix, self.out)
        if named is None:
            named = mine.join(reports.name_outputs(mine.select("path", "status"), earlier, suffix=self.options.suffix, out_dir=self.out).select("path", "dst"), "path")
        good = F.col("status").isin("ok", "clean")
        told = named.select("path", F.when(good, F.col("dst")).alias("dst"), "status", "removed", "error", "src_size", "out_size", "row")
        told.write.mode("overwrite").parquet(f"{self.book}/reports/batch={number}")
        told = self.spark.read.schema("row long, dst string").parquet(f"{self.book}/reports/batch={number}").filter("dst is not null")
        copies.write(done.select("row", F.col("new_content").alias("content")).join(told, "row").select("dst", "content"), self.out, f"batch-{number}")
        store, base = stores.opened(at)
        store.delete_dir(base)
        if self.compact and number % self.compact == self.compact - 1:
            self.ledger.compact(number)

    def start(self, folder: str, log: str, per_trigger: int = 1000) -> StreamingQuery:
        """Everything that is in the folder now, batch by batch; started again with the same log it goes on. Cleaning is part of the stream, so
        that it is planned once and not for each batch; a path that the ledger has is cleaned again under another log, and left out then."""
        for k, v in SMALL_FILES.items():  # the source plans each batch by the session's settings, so they stay
            self.spark.conf.set(k, v)
        stream = clean.clean_files(arrivals(self.spark, folder, per_trigger=per_trigger).select("path", "content"), self.options)
        return stream.writeStream.option("checkpointLocation", log).foreachBatch(self._settle).trigger(availableNow=True).start()


def counts(stream: DataFrame) -> DataFrame:
    """Running counts and bytes saved of each status; write them in complete mode."""
    good = F.col("status").isin("ok", "clean")
    return stream.groupBy("status").agg(F.count("*").alias("n_files"), F.sum(F.when(good, F.greatest(F.col("src_size") - F.col("out_size"), F.lit(0))).otherwise(0)).alias("bytes_saved"))


def start(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into a folder of Parquet, exactly once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def start_counts(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The last state of a complete-mode aggregate, overwritten by each batch."""
    return counts(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(folder)).trigger(availableNow=True).start()


EVENTS = "path string, at long, event string, attempt int, status string"
QUEUE = "path string, state string, attempt int, status string"
COMMANDS = ("retry", "reclean", "clear")
#: For each path the latest start, finish and command; the greatest of each, so neither order nor repeats matter.
ITEM = "started int, finish_attempt int, finish_at long, finish_status string, command_at long, command string"


def queue(events: DataFrame) -> DataFrame:
    """(QUEUE) of each path in events (EVENTS: add, start, finish, retry, reclean, clear; at gives their order): working while an attempt that
    was started has not finished, whatever is commanded; else pending with the next attempt if the latest command is behind the last
    finish and asks for it, cleared if it says so, done, or pending for the first time."""
    when = lambda e, *c: F.max(F.when(F.col("event").isin(*e), F.struct(*c)))
    each = events.groupBy("path").agg(F.max(F.when(F.col("event") == "start", F.col("attempt"))).alias("started"), when(["finish"], "attempt", "at", "status").alias("f"), when(COMMANDS, "at", "event").alias("c"))
    working = F.coalesce(F.col("started") > F.coalesce("f.attempt", F.lit(-1)), F.lit(False))
    later = F.coalesce(F.col("c.at") > F.coalesce("f.at", F.lit(-(1 << 62))), F.lit(False))
    state = F.when(working, "working").when(later & (F.col("c.event") == "clear"), "cleared").when(later, "pending").when(F.col("f").isNotNull(), "done").otherwise("pending")
    following = F.coalesce(F.col("f.attempt") + 1, F.lit(0))
    attempt = F.when(working, F.col("started")).when(later & (F.col("c.event") != "clear"), following).otherwise(F.coalesce("f.attempt", F.lit(0)))
    return each.select("path", state.alias("state"), attempt.cast("int").alias("attempt"), F.col("f.status").alias("status"))


class Items(StatefulProcessor):
    """The same for a stream of events: the state of a path is one row, and each batch tells the rows of its paths anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", ITEM)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        started, finish, command = None, None, None
        if self.item.exists():
            s = self.item.get()
            started = s[0]
            finish = None if s[1] is None else (s[1], s[2], s[3])
            command = None if s[5] is None else (s[4], s[5])
        for r in rows:
            if r.event == "start":
                started = r.attempt if started is None else max(started, r.attempt)
            elif r.event == "finish":
                finish = max(filter(None, (finish, (r.attempt, r.at, r.status))))
            elif r.event in COMMANDS:
                command = max(filter(None, (command, (r.at, r.event))))
        self.item.update((started, *(finish or (None, None, None)), *(command or (None, None))))
        last, at, status = finish or (-1, -(1 << 62), None)
        if started is not None and started > last:
            state, attempt = "working", started
        elif command and command[0] > at:
            state, attempt = ("cleared", max(last, 0)) if command[1] == "clear" else ("pending", last + 1)
        else:
            state, attempt = "done" if finish else "pending", max(last, 0)
        yield Row(path=key[0], state=state, attempt=attempt, status=status)

    def close(self) -> None:
        pass


def requeue(stream: DataFrame) -> DataFrame:
    """``queue`` of a stream of events, in update mode. It needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    return stream.groupBy("path").transformWithState(Items(), outputStructType=QUEUE, outputMode="Update", timeMode="None")


def start_requeue(stream: DataFrame, folder: str, log: str) -> StreamingQuery:
    """Each batch's rows below folder under its number, so that a batch that is run again changes nothing."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    put = lambda df, number: df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")
    return requeue(stream).writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(put).trigger(availableNow=True).start()


def queued(spark: SparkSession, folder: str) -> DataFrame:
    """(QUEUE): the last row of each path."""
    rows = spark.read.schema(f"{QUEUE}, batch long").parquet(folder)
    return rows.groupBy("path").agg(F.max_by(F.struct("state", "attempt", "status"), "batch").alias("x")).select("path", "x.*")


def reclean(results: DataFrame, commands: DataFrame) -> DataFrame:
    """(path, attempt) to clean again: finished items whose latest command (path, at, command) is retry or reclean."""
    latest = commands.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), "command"))).filter("_k = 1 and command in ('retry', 'reclean')").select("path")
    done = results.groupBy("path").agg(F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status")).filter("status is not null")
    return done.join(latest, "path", "left_semi").select("path", (F.col("attempt") + 1).alias("attempt"))
