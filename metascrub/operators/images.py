"""JPEG, PNG and WebP containers as rows of pieces: a helper splits a file, an ordered rule table in SQL names the pieces that go,
and a helper joins those that stay. Nothing is shuffled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascrub.operators.packages import Rule

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Ancillary PNG chunks that stay.
PNG_KEEP = ("tRNS", "gAMA", "cHRM", "sRGB", "bKGD", "hIST", "sPLT", "sBIT", "pHYs")
#: VP8X flag bits of dropped WebP chunks.
WEBP_FLAGS = {"EXIF": 0x08, "XMP ": 0x10, "ICCP": 0x02}
#: Tags of a TIFF structure that hold places of other directories; those that name a person, device, place or time; bytes of a value by type.
DIRECTORY_TAGS = {0x014A: "sub", 0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
IDENTITY_TAGS = {271, 272, 305, 306, 315, 33432, 34855, 36867, 36868, 42036, 42037, 37377, 37378, 37380, 37382, 37383, 37385}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8, 13: 4}
#: Report texts in order, by format; a category without one is not told.
TOLD = {
    "jpeg": [("exif", "EXIF metadata"), ("gps", "GPS location ({})"), ("xmp", "XMP metadata"), ("icc", "ICC color profile"), ("comment", "embedded comment"), ("photoshop", "Photoshop metadata (layers/paths/IPTC)"), ("other", "{} other embedded block(s)")],
    "png": [("text", "{} text chunk(s)"), ("exif", "EXIF metadata"), ("gps", "GPS location ({})"), ("time", "modification timestamp"), ("icc", "ICC color profile"), ("other", "{} unknown chunk(s)")],
    "webp": [("exif", "EXIF metadata"), ("xmp", "XMP metadata"), ("icc", "ICC color profile")],
}


#: The rules by format, in order. test: SQL over piece, its name, and head, its first 40 payload bytes as text.
RULES = {
    "jpeg": [
        Rule("piece in ('scan', 'tail', '01', 'EE') or piece between 'C0' and 'DF'", "keep", "picture"), Rule("piece = 'E0' and left(head, 5) = concat('JFIF', char(0))", "keep", "picture"), Rule("piece = 'E1' and left(head, 6) = concat('Exif', char(0), char(0))", "drop", "exif"),
        Rule("piece = 'E1' and left(head, 29) = concat('http://ns.adobe.com/xap/1.0/', char(0))", "drop", "xmp"), Rule("piece = 'E2' and left(head, 12) = concat('ICC_PROFILE', char(0))", "drop", "icc"), Rule("piece = 'FE'", "drop", "comment"), Rule("piece = 'ED'", "drop", "photoshop"), Rule("true", "drop", "other"),
    ],
    "png": [
        Rule(f"piece in ('signature', 'tail', 'IEND', {', '.join(map(repr, PNG_KEEP))})", "keep", "picture"), Rule("piece = 'iCCP'", "drop", "icc"), Rule("piece in ('tEXt', 'zTXt', 'iTXt')", "drop", "text"), Rule("piece = 'eXIf'", "drop", "exif"),
        Rule("piece = 'tIME'", "drop", "time"), Rule("left(piece, 1) between 'a' and 'z'", "drop", "other"),
    ],
    "webp": [Rule("piece = 'EXIF'", "drop", "exif"), Rule("piece = 'XMP '", "drop", "xmp"), Rule("piece = 'ICCP'", "drop", "icc")],
}


class Part(NamedTuple):
    """A stretch of the file: its kind, its bytes, and where its payload starts and stops."""

    kind: str
    start: int
    stop: int
    inner: int
    end: int


class Piece(NamedTuple):
    """What the splitter gives: pieces hold all bytes of a file; what no part holds is ``gap``. good: whole, as far as it tells."""

    kind: str
    data: bytes
    good: bool


def jpeg_parts(data: bytes) -> Iterator[Part]:
    """Segments of a JPEG; kind is the marker in hex, ``scan`` from the first scan to its end mark, ``tail`` what does not parse."""
    at, n = 2, len(data)

    def rest(kind: str, start: int, search: int) -> Part:
        end = data.find(b"\xff\xd9", search)
        stop = n if end < 0 else end + 2
        return Part(kind, start, stop, start, stop)

    yield Part("D8", 0, 2, 2, 2)
    while at < n - 1:
        if data[at] != 0xFF:
            yield rest("tail", at, at)
            return
        mark = data[at + 1]
        if mark in (0x00, 0xFF):  # fill
            at += 1
        elif mark in (0x01, 0xD8, 0xD9) or 0xD0 <= mark <= 0xD7:
            yield Part(f"{mark:02X}", at, at + 2, at + 2, at + 2)
            if mark == 0xD9:
                return
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big") if at + 4 <= n else 0
            if at + 4 > n or mark != 0xDA and (size < 2 or at + 2 + size > n):
                yield Part("tail", at, n, at, n)
                return
            if mark == 0xDA:
                yield rest("scan", at, at + 2 + size)
                return
            yield Part(f"{mark:02X}", at, at + 2 + size, at + 4, at + 2 + size)
            at += 2 + size


def png_parts(data: bytes) -> Iterator[Part]:
    at, n = 8, len(data)
    yield Part("signature", 0, 8, 8, 8)
    while at + 8 <= n:
        stop = at + 12 + int.from_bytes(data[at : at + 4], "big")
        if stop > n:
            yield Part("tail", at, n, at, n)
            return
        kind = data[at + 4 : at + 8].decode("latin-1")
        yield Part(kind, at, stop, at + 8, stop - 4)
        if kind == "IEND":
            return
        at = stop


def webp_parts(data: bytes) -> Iterator[Part]:
    at, n = 12, len(data)
    while at + 8 <= n:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if end > n:
            return
        yield Part(data[at : at + 4].decode("latin-1"), at, end, at + 8, end)
        at = end + (end - at) % 2


FORMATS = {"jpeg": jpeg_parts, "png": png_parts, "webp": webp_parts}


def pieces(data: bytes, form: str) -> Iterator[Piece]:
    at = 0
    for p in FORMATS[form](data):
        if p.start > at:
            yield Piece("gap", data[at : p.start], form != "webp" or at > 0 or int.from_bytes(data[4:8], "little") + 8 <= len(data) + 1)
        whole = form != "png" or p.kind in ("signature", "tail") or zlib.crc32(data[p.start + 4 : p.end]) == int.from_bytes(data[p.end : p.stop], "big")
        yield Piece(p.kind, data[p.start : p.stop], whole)
        at = p.stop
    if at < len(data):
        yield Piece("gap", data[at:], True)


def joined(form: str, kept: list[tuple[str, bytes]], dropped: set[str]) -> bytes:
    """The file of the pieces that stay; without dropped ones it is what it was, else gaps go, and WebP gets its sizes and flags."""
    if not dropped:
        return b"".join(d for _, d in kept)
    kept = [(k, d) for k, d in kept if k != "gap"]
    if form != "webp":
        return b"".join(d for _, d in kept)
    body = []
    for kind, data in kept:
        if kind == "VP8X" and len(data) > 8:
            data = data[:8] + bytes([data[8] & ~sum(WEBP_FLAGS.get(k, 0) for k in dropped)]) + data[9:]
        body += [data, b"\0" * (len(data) % 2)]
    all_ = b"".join(body)
    return b"RIFF" + struct.pack("<I", 4 + len(all_)) + b"WEBP" + all_


def family(data: bytes) -> str | None:
    if data[:2] == b"\xff\xd8" and len(data) >= 4:
        return "jpeg"
    return "png" if data[:8] == PNG_SIGNATURE else "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def ifd(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    """tag: (type, count, value bytes) of one directory, up to the first entry that is cut; the first of a tag counts."""
    found: dict[int, tuple[int, int, bytes]] = {}
    if not 0 <= at <= len(data) - 2:
        return found
    for k in range(int.from_bytes(data[at : at + 2], order)):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind, count = (int.from_bytes(entry[a:b], order) for a, b in ((0, 2), (2, 4), (4, 8)))
        size = TYPE_BYTES.get(kind, 0) * count
        where = int.from_bytes(entry[8:], order)
        raw = entry[8 : 8 + size] if size <= 4 else data[where : where + size]
        found.setdefault(tag, (kind, count, raw if len(raw) == size else b""))
    return found


def exif(blob: bytes) -> tuple[dict, dict, str] | None:
    """The main and the GPS directory of a TIFF structure (with or without the Exif head) and its byte order."""
    data = blob[6:] if blob[:6] == b"Exif\0\0" else blob
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if len(data) < 8 or not order or int.from_bytes(data[2:4], order) != 42:
        return None
    main = ifd(data, int.from_bytes(data[4:8], order), order)
    kind, count, raw = main.get(0x8825, (0, 0, b""))
    return main, ifd(data, int.from_bytes(raw, order), order) if (kind, count) == (4, 1) else {}, order


def directories(blob: bytes) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(directory, tag, type, count, value) of all directories of a TIFF structure: page after page (``0``, ``1``, ...), and below each those
    that its tags name (``0/exif``, ``1/sub0``). Each place is read once, so a chain that leads back to itself ends."""
    data = blob[6:] if blob[:6] == b"Exif\0\0" else blob
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if len(data) < 8 or not order or int.from_bytes(data[2:4], order) != 42:
        return
    seen, page, at = set(), 0, int.from_bytes(data[4:8], order)
    while at and at not in seen and at + 2 <= len(data):
        waiting = [(str(page), at)]
        while waiting:
            name, here = waiting.pop(0)
            if here in seen:
                continue
            seen.add(here)
            for tag, (kind, count, raw) in ifd(data, here, order).items():
                yield name, tag, kind, count, raw
                if tag in DIRECTORY_TAGS and kind in (4, 13):
                    below = [int.from_bytes(raw[k : k + 4], order) for k in range(0, len(raw) - 3, 4)]
                    waiting += [(f"{name}/{DIRECTORY_TAGS[tag]}{k if tag == 0x014A else ''}", x) for k, x in enumerate(below)]
        following = at + 2 + 12 * int.from_bytes(data[at : at + 2], order)
        page, at = page + 1, int.from_bytes(data[following : following + 4], order)


def gps(blob: bytes) -> dict | None:
    """lat and lon as three numbers each with their reference letters, or None on anything unexpected. Never raises."""
    found = exif(blob)
    if found is None:
        return None
    _, where, order = found

    def numbers(tag: int) -> list[float] | None:
        kind, _, raw = where.get(tag, (0, 0, b""))
        if kind != 5 or len(raw) < 24:
            return None
        pairs = [(int.from_bytes(raw[k : k + 4], order), int.from_bytes(raw[k + 4 : k + 8], order)) for k in (0, 8, 16)]
        return None if any(d == 0 for _, d in pairs) else [n / d for n, d in pairs]

    letters = lambda tag: where.get(tag, (0, 0, b""))[2].rstrip(b"\0").decode("ascii", "ignore")
    lat, lon = numbers(2), numbers(4)
    return None if lat is None or lon is None else {"lat": lat, "lat_ref": letters(1), "lon": lon, "lon_ref": letters(3)}


def gps_text(g: dict) -> str:
    return ", ".join(f"{int(g[k][0])}°{int(g[k][1])}'{g[k][2]:.0f}\"{g[k + '_ref']}" for k in ("lat", "lon"))


def sound(form: Column, kinds: Column, good: Column) -> Column:
    """The structure that a decoder needs, from the distinct kinds of pieces in order: JPEG a frame and a scan and nothing that does not
    parse, PNG from IHDR to IEND with checksums, WebP its size and an image."""
    has = lambda k: F.array_contains(kinds, k)
    jpeg = ~has("tail") & has("scan") & F.exists(kinds, lambda k: k.between("C0", "CF") & ~k.isin("C4", "C8", "CC"))
    png = good & (F.get(kinds, F.lit(1)) == "IHDR") & has("IDAT") & has("IEND") & ~has("tail")
    return F.coalesce(F.when(form == "jpeg", jpeg).when(form == "png", png).when(form == "webp", good & F.exists(kinds, lambda k: k.isin("VP8 ", "VP8L", "VP8X", "ANMF"))), F.lit(False))


def rule(rules: dict[str, list[Rule]], form: str = "format", pick: str = "category") -> str:
    """SQL for the category of a piece that goes by the first rule that holds, else null; over format, piece and head."""
    by_format = lambda f: "case when piece = 'gap' then null " + " ".join(f"when {r.test} then " + (f"'{getattr(r, pick)}'" if r.action == "drop" else "null") for r in rules[f]) + " end"
    return f"case {form} " + " ".join(f"when '{f}' then {by_format(f)}" for f in rules) + " end"


def head(data: Column, form: Column) -> Column:
    """The first 40 payload bytes of a piece as text of one character each."""
    return F.decode(F.substring(F.coalesce(data, F.lit(b"")), F.when(form == "jpeg", 5).otherwise(9), F.lit(40)), "ISO-8859-1")


def told(form: Column, counts: Column, place: Column) -> Column:
    """Report texts in order."""
    out = F.array().cast("array<string>")
    for name, texts in TOLD.items():
        each = []
        for category, text in texts:
            value = place if category == "gps" else F.nullif(F.coalesce(F.element_at(counts, category), F.lit(0)), F.lit(0)).cast("string")
            before, *after = text.split("{}")
            each.append(F.when(value.isNotNull(), F.concat(F.lit(before), value, F.lit(after[0])) if after else F.lit(text)))
        out = F.when(form == name, F.array_compact(F.array(*each))).otherwise(out)
    return out


PARTS = "part_seq int, part_kind string, start long, n_bytes long, head binary"


def _each(files: DataFrame, schema: str, types: list[pa.DataType], answer) -> DataFrame:
    """files' columns but content, and for each file the rows that answer(content) gives."""
    keep = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows, take = [], []
            for k, content in enumerate(batch.column("content")):
                for row in answer(content.as_py()):
                    rows.append(row)
                    take.append(k)
            columns = [batch.column(c).take(pa.array(take, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True))], names=[*keep, *names])

    head = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, "content").mapInArrow(run, f"{head}, {schema}")


def explode_parts(files: DataFrame, rules: dict[str, list[Rule]] = RULES) -> DataFrame:
    """A row for each part of each image, with the category of those that can go."""

    def answer(content: bytes | None):
        form = family(content or b"")
        for k, p in enumerate(FORMATS[form](content) if form else ()):
            yield form, k, p.kind, p.start, p.stop - p.start, content[p.inner : p.end][:40]

    found = _each(files, f"format string, {PARTS}", [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()], answer)
    found = found.withColumns({"piece": F.col("part_kind"), "head": F.decode("head", "ISO-8859-1")}).withColumn("category", F.expr(rule(rules)))
    return found.drop("format", "piece", "head")


def gps_of(blobs: DataFrame) -> DataFrame:
    """blobs with lat, lat_ref, lon, lon_ref and identity (a tag that names someone is there) instead of content."""

    def answer(content: bytes | None):
        g, found = gps(content or b"") or {}, exif(content or b"")
        yield g.get("lat"), g.get("lat_ref"), g.get("lon"), g.get("lon_ref"), bool(found and IDENTITY_TAGS & set(found[0]))

    return _each(blobs, "lat array<double>, lat_ref string, lon array<double>, lon_ref string, identity boolean", [pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64()), pa.string(), pa.bool_()], answer)


def directory_rows(blobs: DataFrame) -> DataFrame:
    """blobs with a row (directory, tag, type, n_values, value) for each entry of each TIFF directory instead of content; what is no TIFF
    structure has none."""

    def answer(content: bytes | None):
        yield from directories(content or b"")

    return _each(blobs, "directory string, tag int, type int, n_values long, value binary", [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], answer)


def identity(rows: DataFrame) -> DataFrame:
    """The rows whose tags name a person, device, place or time, in whatever directory; GPS directories have tags of their own."""
    tags = rows.sparkSession.createDataFrame([(t,) for t in sorted(IDENTITY_TAGS)], "tag int")  # a fixed few
    return rows.filter(~F.col("directory").endswith("/gps")).join(F.broadcast(tags), "tag", "left_semi")


def signature(content: F.Column, kind: str) -> F.Column:
    """Whether the bytes start as a file of the kind."""
    head = F.hex(F.substring(content, 1, 12))
    if kind == "svg":
        return F.instr(F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1")), F.lit("<svg")) > 0
    return {"jpeg": head.startswith("FFD8"), "png": head.startswith(PNG_SIGNATURE.hex().upper()), "webp": head.startswith(b"RIFF".hex().upper()) & head.endswith(b"WEBP".hex().upper())}[kind]
