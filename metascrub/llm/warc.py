"""WARC writing with revisit records, and a salvage reader.

Records are composed by built-in functions; a task packs the records it holds into archives of bounded size, each record
a gzip member, as a table (archive, content) that is written through Spark's own commit protocol. The reader takes such
a table, or the path and content of Spark's ``binaryFile`` source. It checks each record (gzip checksum, version line,
length, end marks, payload digest). After a failed check it searches for the next place where a whole valid record
starts - a gzip member or a version line - reads on from there, and logs the bytes between as a quarantined gap. Inside
a member it does the same with the inflated bytes, also of a member that is damaged or cut: records before the fault count.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascrub.llm import store
from metascrub.llm import text as tx

ARCHIVE_BYTES = 8 << 20
LEAST_REVISIT = 1000  #: bytes; smaller payloads are always written whole
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
STEP = 1 << 16  #: bytes that are unpacked at once
MEMBER = b"\x1f\x8b\x08"
READ = "archive string, start long, stop long, kind string, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, reason string"


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): of pages with equal payloads of LEAST_REVISIT bytes or more the one with the largest page_id is a
    response, the others are revisits of it. Nulls: html is empty, url is empty; a null page_id is less than any, and
    pages that have none refer to no other page without one. Rows that share the largest page_id are responses, all of them.
    Extra columns are ignored; no pages give no records. A record's id names the page and a hash of the row, so different
    rows of one page_id have different ids."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    key = F.lower(F.lpad(F.hex(tx.row_key("page_id", "url", "html")), 16, "0"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), key.alias("key"), url.alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # payloads that stand twice or more; rows without one of these are not dealt by it
    twice = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max(F.struct("page_id", "key")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(twice, ["digest", "size"], "left")
    again = F.col("first.page_id").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    told = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    http = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("size").cast("string"), "\r\n\r\n")
    body = F.when(again, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    ident = lambda page, own: text("<urn:page:", F.coalesce(page.cast("string"), F.lit("")), ":", own, ">")
    head = text(
        "WARC/1.1\r\nWARC-Type: ", F.when(again, "revisit").otherwise("response"), "\r\nWARC-Record-ID: ", ident(F.col("page_id"), F.col("key")), "\r\nWARC-Target-URI: ", told,
        "\r\nWARC-Date: 1980-01-01T00:00:00Z\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:", F.col("digest"),
        F.when(again, text("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: ", ident(F.col("first.page_id"), F.col("first.key")))).otherwise(""),
        "\r\nContent-Length: ", F.octet_length("_body").cast("string"), "\r\n\r\n")
    return rows.withColumn("_body", body).select("page_id", F.concat(head.cast("binary"), F.col("_body"), F.lit("\r\n\r\n").cast("binary")).alias("record"))


def archives(rows: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): the records as gzip members in archives of about ``most`` bytes, or of one record."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, size = [], None, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{name}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                member = gzip.compress(record, 3, mtime=0)
                if held and size + len(member) > most:
                    yield out()
                    held, name, size = [], None, 0
                name = f"{page if page is not None else 'x'}-{zlib.crc32(member):08x}" if name is None else name
                held.append(member)
                size += len(member)
        if held:
            yield out()

    return rows.mapInArrow(pack, "archive string, content binary")


def differs(digest: str, payload: bytes) -> bool | None:
    """Whether a digest, in hex or base32, is not that of the payload; None if its algorithm is unknown."""
    name, colon, told = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    own, told = hashlib.new(name, payload).digest(), told.strip()
    if len(told) == 2 * len(own):
        return told.lower() != own.hex()
    return told.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


def parse(record: bytes, at: int = 0) -> tuple[int, dict | None, str]:
    """The record that starts at a place: where it ends, and its fields or why it is none."""
    if not record.startswith(VERSIONS, at):
        return 0, None, "no version line"
    end = record.find(b"\r\n\r\n", at)
    if end < 0:
        return 0, None, "no end of header"
    fields = {}
    for line in record[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return 0, None, "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        return 0, None, "bad length"
    stop = end + 4 + int(length)
    if record[stop : stop + 4] != b"\r\n\r\n":
        return 0, None, "no end marks"
    block = record[end + 4 : stop]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            return 0, None, "bad http header"
        told = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(told[0]) if told and told[0].isdigit() else len(payload)
    digest = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") != "revisit":
        wrong = differs(digest, payload)
        if wrong:
            return 0, None, "payload digest differs"
        fields["checked"] = wrong is not None
        size = len(payload)
    return stop + 4, fields | {"payload": payload, "size": size}, ""


def read_member(data: bytes, at: int) -> tuple[int, list[dict], str]:
    """The records of the member, or the plain record, that starts at a place: where it ends, and what was wrong, if anything.
    Of a damaged member only records whose digest was checked count. A damaged or cut one ends where it starts."""
    if data.startswith(VERSIONS, at):
        stop, record, why = parse(data, at)
        return (stop, [record], "") if record else (at, [], why)
    if not data.startswith(MEMBER, at):
        return at, [], "neither a member nor a version line"
    unpack, view, inside, stop = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not unpack.eof and stop < len(data):
            before = unpack.copy()
            inside.append(unpack.decompress(view[stop : stop + STEP]))
            stop = min(stop + STEP, len(data))
    except zlib.error:
        broken = "damaged member"
        with contextlib.suppress(zlib.error):  # what comes before the fault
            for k in range(stop, len(data)):
                inside.append(before.decompress(view[k : k + 1]))
    else:
        broken = "" if unpack.eof else "cut member"
    stop, inside = stop - len(unpack.unused_data), b"".join(inside)
    found, why, place = [], broken, 0
    while place < len(inside):
        end, record, wrong = parse(inside, place)
        if record is not None:
            if broken != "damaged member" or record.get("checked"):
                found.append(record)
            place = end
            continue
        why = why or wrong
        again = VERSION.search(inside, place + 1)
        place = again.start() if again else len(inside)
    if not found:
        return at, [], why or "empty member"
    return (at if broken else stop), found, why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, stop, record, reason) in order of place: records, and gaps (record None) with what was wrong at their start.
    A gap of which records were saved has their places."""
    at, places = 0, {MEMBER: -1, b"WARC/1.": -1}  # of each mark the next place that is known
    while at < len(data):
        stop, found, why = read_member(data, at)
        if stop > at:
            for record in found:
                yield at, stop, record, ""
            if why:
                yield at, stop, None, why
            at = stop
            continue
        start, at = at, at + 1
        while at < len(data):
            for mark, place in places.items():
                if place < at:
                    places[mark] = p if (p := data.find(mark, at)) >= 0 else len(data)
            at = min(places.values())
            if at < len(data) and read_member(data, at)[1]:
                break
            at += 1
        at = min(at, len(data))
        for record in found:
            yield start, at, record, ""
        yield start, at, None, why


def read(archived: DataFrame, payloads: bool = False) -> DataFrame:
    """READ rows of (archive, content): kind is ``record`` or ``gap``. payloads: with the payloads themselves. A null or
    empty content gives no rows; extra columns are ignored; an archive given twice is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                name, data, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), []
                for start, stop, r, why in salvage(data or b""):
                    if r is None:
                        rows.append((name, start, stop, "gap", *[None] * 7, why))
                    else:
                        rows.append((name, start, stop, "record", r.get("warc-type"), r.get("warc-record-id"), r.get("warc-target-uri"), r.get("warc-refers-to"), r.get("warc-payload-digest"), r["size"], r["payload"] if payloads else None, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archived.select("archive", "content").mapInArrow(run, READ)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    written = store.saved(archives(records(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "warc")
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*):[0-9a-f]{16}>$", 1), F.lit("")).cast("long")
    rows = read(written).filter("kind = 'record'")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
r as (select payload_digest, payload_bytes, max(page_id) as first from p where payload_bytes >= 1000 group by all)
select page_id, payload_bytes, payload_digest, case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when first is distinct from page_id then first end as refers_to
from p left join r using (payload_digest, payload_bytes)
"""
