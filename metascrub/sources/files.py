"""Discovery of files, reading them by path, and the sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascrub.functions import paths
from metascrub.sources import copies, stores

MAX_BYTES = 512 << 20
BIN_BYTES, OPEN_COST = 128 << 20, 1 << 20  #: of one task, and what opening a file costs in bytes
MOST_BINS = 50_000


def discover(spark: SparkSession, *roots: str, content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of all files under the roots, recursively. Names that start with . or _
    are not listed by Spark; ``walk`` lists them, too. Without content nothing is opened, so the listing passes any size."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return df if content else df.select("path", "modificationTime", "length")


def missing(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Requested paths that were not found."""
    return requested.select("path").distinct().join(found.select("path"), "path", "left_anti")


def supported(walked: DataFrame, named: DataFrame) -> DataFrame:
    """path, status, error: walked files of supported extensions, and every named file; an unsupported one is skipped."""
    low = F.lower(paths.ext(F.col("path")))
    every = walked.filter(low.isin(paths.SUPPORTED)).select("path").unionByName(named.select("path")).distinct()
    error = paths.unsupported(F.col("path"))
    return every.select("path", F.when(error.isNotNull(), "skipped").alias("status"), error.alias("error"))


def size_limit(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """files with status and error of those over the limit; test it before content is read."""
    over = F.col("length") > most
    return files.withColumns({"status": F.when(over, "error"), "error": F.when(over, F.concat(F.lit("file too large: "), paths.base(F.col("path"))))})


LISTED = "path string, is_folder boolean, length long, modificationTime timestamp"


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in each folder; of a file the file itself, of what is not there nothing."""
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            fs, at = stores.opened(path)
            prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
            info = fs.get_file_info(at)
            for x in fs.get_file_info(pafs.FileSelector(at)) if info.type == pafs.FileType.Directory else [info]:
                folder = x.type == pafs.FileType.Directory
                loops = folder and isinstance(fs, pafs.LocalFileSystem) and os.path.islink(x.path)
                if (folder or x.type == pafs.FileType.File) and not loops:
                    rows.append((prefix + x.path, folder, None if folder else x.size, x.mtime))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")))], names=["path", "is_folder", "length", "modificationTime"])


def walk(spark: SparkSession, *roots: str) -> DataFrame:
    """path, modificationTime, length of all files under the roots, also of names that start with . or _ , which ``discover`` leaves
    out. Folders of one depth are listed side by side by tasks, depth by depth; links to folders are not followed."""
    level, found = spark.createDataFrame([(r,) for r in roots], "path string"), None
    while True:
        listed = stores.saved(level.repartition("path").mapInArrow(_children, LISTED), "listing")
        files = listed.filter("not is_folder").select("path", "modificationTime", "length")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("is_folder").select("path")
        if not level.take(1):
            return found


def bins(listing: DataFrame, size: int = BIN_BYTES) -> tuple[DataFrame, int]:
    """(path, length, bin) and the number of bins: files go to bins in the order in which they stand in their partition, until a
    bin holds ``size`` bytes, so that no shuffle or sort finds them. ``size`` grows with the listing, for ``MOST_BINS`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = 0, 0
        for batch in batches:
            out = []
            for length in batch.column(1).to_pylist():
                cost = (length or 0) + OPEN_COST
                if held and held + cost > size:
                    held, own = 0, own + 1
                held += cost
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), batch.column(2)], names=["path", "length", "own", "part"])

    listing = stores.saved(listing.select("path", F.col("length").cast("long")), "paths")
    total, n = listing.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    size = max(size, (total + n * OPEN_COST) // MOST_BINS)
    dealt = stores.saved(listing.select("path", "length", F.spark_partition_id().alias("part")).mapInArrow(run, "path string, length long, own long, part int"), "bins")
    first, k = {}, 0  # a number for each partition of the listing
    for part, last in dealt.groupBy("part").agg(F.max("own")).orderBy("part").collect():
        first[part], k = k, k + last + 1
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("part")) if first else F.lit(0)
    return dealt.select("path", "length", (F.col("own") + offset).cast("int").alias("bin")), k


def read(listing: DataFrame, most: int = MAX_BYTES, size: int = BIN_BYTES) -> DataFrame:
    """(path, length, content, error) of a table of paths with lengths, of any names. A file over ``most`` is an error row and is
    never opened; one that is gone, or has grown over it since, is an error row, too. Bins of about ``size`` bytes are read by a
    task each, and rows are handed on file by file, so a task holds one file. Paths are opened as ``stores.opened`` can."""
    over = F.concat(F.lit("file too large: "), paths.base(F.col("path")))
    known = listing.select("path", F.col("length").cast("long"))
    large = known.filter(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), over.alias("error"))
    placed, n = bins(known.filter(F.coalesce("length", F.lit(0)) <= most), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = stores.opened(path)
                content, error, length = None, None, None
                try:
                    info = fs.get_file_info(at)
                    length = info.size
                    if info.type != pafs.FileType.File:
                        error = f"file not found: {path.rsplit('/', 1)[-1]}"
                    elif length > most:
                        error = f"file too large: {path.rsplit('/', 1)[-1]}"
                    else:
                        with fs.open_input_stream(at) as f:
                            content = f.read()
                except OSError as e:
                    error = f"could not be read ({type(e).__name__}): {path.rsplit('/', 1)[-1]}"
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((path, pa.string()), (length, pa.int64()), (content, pa.binary()), (error, pa.string()))], names=["path", "length", "content", "error"])

    done = placed.repartitionById(max(n, 1), "bin").select("path").mapInArrow(run, "path string, length long, content binary, error string")
    return done.unionByName(large)


def write_copies(outputs: DataFrame, root: str, job: str | None = None) -> int:
    """(dst, content) as files under their names below root, in two phases (see ``copies``); the number of files."""
    return copies.write(outputs, root, job)


def write_outputs(outputs: DataFrame, folder: str) -> None:
    """(path, dst, content) as Parquet, through Spark's commit protocol; originals are never touched."""
    outputs.select("path", "dst", "content").write.mode("errorifexists").parquet(folder)


def write_report(lines: DataFrame, folder: str, one_file: bool = False, most: int = 1_000_000) -> None:
    """The text report in sorted parts; as one file only if it has ``most`` lines at most, else an error, as one task writes it."""
    if one_file and lines.count() > most:
        raise ValueError(f"a report of one file has {most} lines at most")
    ordered = lines.orderBy("section", "seq", "n").select("line")
    (ordered.coalesce(1) if one_file else ordered).write.mode("errorifexists").text(folder)
