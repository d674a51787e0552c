"""Zip packages: entries as rows with bounded inflation, and packing with normalised entries."""

from __future__ import annotations

import hashlib
import io
import warnings
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, STEP = 20_000, 512 << 20, 1 << 30, 1 << 20
EPOCH = (1980, 1, 1, 0, 0, 0)


def entries(content: bytes, max_entries: int = MAX_ENTRIES, max_entry: int = MAX_ENTRY, max_total: int = MAX_TOTAL, by_name: bool = False) -> Iterator[tuple[int, str, bytes | None, str | None]]:
    """(number, name, bytes, verdict) of each entry in order, numbers from 0; a verdict ends the archive. Inflates by blocks and stops at
    the limits. by_name: of entries with one name each gets the bytes of the last."""
    k = -1
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos, total = z.infolist(), 0
            if not infos or len(infos) > max_entries:
                yield 0, "", None, "no entries" if not infos else "too many entries"
                return
            for k, info in enumerate(infos):
                if info.flag_bits & 1:
                    yield k, info.filename, None, "encrypted"
                    return
                blocks, size = [], 0
                with z.open(info.filename if by_name else info) as f:
                    while block := f.read(STEP):
                        size, total = size + len(block), total + len(block)
                        if size > max_entry or total > max_total:
                            yield k, info.filename, None, "entry too large" if size > max_entry else "archive too large"
                            return
                        blocks.append(block)
                yield k, info.filename, b"".join(blocks), None
    except Exception:  # whatever a hostile archive does
        yield k + 1, "", None, "not a valid archive"


def pack(parts: list[tuple[str, bytes]]) -> bytes:
    """A zip of the parts in order."""
    packer = Packer()
    for name, data in parts:
        packer.add(name, data)
    return packer.done()


class Packer:
    """A zip that is written entry by entry: folders left out, fixed time, no attributes."""

    def __init__(self):
        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.names: set[str] = set()

    def add(self, name: str, data: bytes) -> None:
        if not name.endswith("/"):
            info = zipfile.ZipInfo(name, EPOCH)
            info.create_system, info.external_attr, info.compress_type = 0, 0, zipfile.ZIP_DEFLATED
            if name in self.names:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", UserWarning)  # entries of one name
                    self.zip.writestr(info, data)
            else:
                self.names.add(name)
                self.zip.writestr(info, data)
            info.external_attr = 0  # writing sets a mode; the directory at the end is written from here

    def done(self) -> bytes:
        self.zip.close()
        return self.out.getvalue()


def unzip_parts(files: DataFrame, key: str, **limits: int) -> DataFrame:
    """(key, part_seq, part_name, data, verdict) of the archives in (key, content); map-only, a row for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for row in entries(batch.column(1)[k].as_py() or b"", **limits):
                    rows.append(row)
                    size += len(row[2] or b"")
                    if size > 16 << 20:
                        yield out(batch.column(0)[k], rows)
                        rows, size = [], 0
                if rows:
                    yield out(batch.column(0)[k], rows)

    def out(own: pa.Scalar, rows: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(rows), own.type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[key, "part_seq", "part_name", "data", "verdict"])

    return files.select(key, "content").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, part_seq int, part_name string, data binary, verdict string")


def pack_zip(parts: DataFrame, key: str) -> DataFrame:
    """(key, content): one zip for each key from (key, part_seq, part_name, data). An archive is at most 1 GiB by contract, so a group fits a task."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part_seq").to_pylist(), table.column("part_name").to_pylist(), table.column("data").to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
        return pa.table({key: table.column(key).slice(0, 1), "content": pa.array([pack([(n, d or b"") for _, n, d in rows])], pa.binary())})

    return parts.select(key, "part_seq", "part_name", "data").groupBy(key).applyInArrow(run, f"{key} {parts.schema[key].dataType.simpleString()}, content binary")


PACKED_BYTES = 16 << 20  #: of archives in one batch


def pack_lists(files: DataFrame, key: str) -> DataFrame:
    """(key, content): one zip for each row of (key, parts), parts being an array of (part_seq, part_name, data); none for a null. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size, first = [], 0, 0

            def out(upto: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, upto - first), pa.array(made, pa.binary())], names=[key, "content"])  # noqa: B023

            for k, listed in enumerate(batch.column(1)):
                rows = zip(*(listed.values.field(c).to_pylist() for c in ("part_seq", "part_name", "data"))) if listed.is_valid else None
                made.append(None if rows is None else pack([(n, d or b"") for _, n, d in sorted(rows, key=lambda r: r[:2])]))
                size += len(made[-1] or b"")
                if size > PACKED_BYTES:
                    yield out(k + 1)
                    made, size, first = [], 0, k + 1
            if made:
                yield out(batch.num_rows)

    return files.select(key, "parts").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, content binary")


def digests(files: DataFrame) -> DataFrame:
    """files with n_parts and digest (MD5 of the names and bytes of all entries in order) instead of content; null where it is no archive."""
    keep = [c for c in files.columns if c != "content"]

    def told(content: bytes | None) -> tuple[int | None, str | None]:
        found, n = hashlib.md5(), 0
        for _, name, data, verdict in entries(content or b""):
            if verdict:
                return None, None
            found.update(name.encode())
            found.update(data)
            n += 1
        return n, found.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest = zip(*(told(c.as_py()) for c in batch.column("content"))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=[*keep, "n_parts", "digest"])

    head = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*keep, "content").mapInArrow(run, f"{head}n_parts long, digest string")
