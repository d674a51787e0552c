"""Cleaning whole files: bytes in, bytes and a report out.

All formats go through one chain without a shuffle, and files are read once: a helper splits each file into parts (entries
of an archive, pieces of an image, the text of an SVG), rules and patterns are built-in functions over the rows of parts,
and a helper packs rows that follow each other until the file ends. Options are columns, so each file can have its own.
What was found comes out with the copies, in the order of the parts. An archive is at most 1 GiB by contract. XML is
rewritten as ISO-8859-1 text, which keeps every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascrub.functions import paths, texts
from metascrub.operators import archives, images, packages
from metascrub.operators import rewrite as rw
from metascrub.sources import files as fs


class Options(NamedTuple):
    """What a job removes beside the rules that always hold, and how its copies are named."""

    strip_icc: bool = False
    remove_scripts: bool = True
    keep_attachments: bool = False
    suffix: str = "_clean"
    subfolder: bool = False


#: Report texts of counters in order; the first of two texts is for one.
COUNTERS = {
    "office": [
        ("macros", "VBA macro project removed", "{} VBA macro parts removed"), ("rsid", "{} edit-session ID(s) removed (rsid)"), ("images", "metadata in {} embedded image(s)"), ("custom XML", "{} custom XML metadata part(s) removed"),
        ("thumbnails", "{} thumbnail(s) removed (unsanitized format)"), ("track changes", "{} track-change author attribution(s) removed"), ("comment ranges", "{} comment reference(s) removed from document"), ("signatures", "{} digital signature part(s) removed"),
        ("PPTX comments", "{} PPTX comment(s) removed"), ("PPTX notes", "{} PPTX speaker note(s) removed"), ("XLSX links", "{} XLSX external link(s) removed"), ("XLSX comments", "{} XLSX sheet comment(s) removed"),
    ],
    "odf": [("macros", "{} macro part(s) removed"), ("changes", "{} track-change field(s) removed"), ("annotations", "{} annotation(s) removed"), ("settings", "{} settings author field(s) removed"), ("custom UI", "{} custom UI part(s) removed")],
}
#: Rules whose categories are told where the part stands, each text once.
INLINE = ("document comments", "comment author list", "extended comment metadata", "comment-to-paragraph mapping")
#: Why an archive is refused, by packages.unsafe_name.
REFUSED = {"bad length": "a suspicious entry name", "absolute path": "an absolute-path entry", "drive letter": "a drive-letter entry", "NUL": "a null-byte entry name", "parent folder": "a path-traversal entry"}
DONE = "new_content binary, removed array<string>, status string, error string"


def lossless(data: Column) -> Column:
    """Bytes as text of one character each."""
    return F.decode(data, "ISO-8859-1")


def readable(data: Column) -> Column:
    """Bytes as UTF-8 text without those that are none."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))


def told_fields(what: str, fields: Column) -> Column:
    return F.when(F.size(fields) > 0, F.concat(F.lit(f"{what} ("), F.array_join(fields, ", "), F.lit(")")))


#: Rules by kind of file; ``clean_files`` takes others.
RULES = {"office": packages.OOXML, "odf": packages.ODF, "image": images.RULES}
#: What a part row carries; the key of its file stands before.
PART = "kind string, strip_icc boolean, remove_scripts boolean, part_seq int, entry int, part_name string, format string, piece string, starts boolean, good boolean, data binary, verdict string"
PART_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.string()]
SPLIT_BYTES = 16 << 20


def _split(files: DataFrame, key: str, **limits: int) -> DataFrame:
    """(key, PART) of files (key, kind, strip_icc, remove_scripts, content): rows of a file follow each other, numbered from 0. Images, also
    in archives where a name says so, are rows of their pieces."""
    own = files.schema[key].dataType.simpleString()

    def parts(kind: str, content: bytes) -> Iterator[tuple]:
        if kind in ("office", "odf"):
            for k, name, data, verdict in archives.entries(content, by_name=True, **limits):
                form = images.family(data or b"") if name.lower().endswith(IMAGE_NAMES) else None
                if form:
                    yield from ((k, name, form, *p, verdict) for p in _told(images.pieces(data, form)))
                else:
                    yield k, name, None, None, False, True, data, verdict
        elif kind == "image":
            form = images.family(content)
            if form is None:
                yield 0, "", None, None, False, True, None, "not a valid image"
            else:
                yield from ((0, "", form, *p, None) for p in _told(images.pieces(content, form)))
        else:
            yield 0, "", None, None, False, True, content if kind == "svg" else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(c.split()[0] for c in PART.split(", "))]
        for batch in batches:
            rows, take, size = [], [], 0

            def out() -> pa.RecordBatch:
                same = batch.select(range(4)).take(pa.array(take, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*same.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PART_TYPES, strict=True))], names=names)  # noqa: B023

            for k, kind in enumerate(batch.column(1).to_pylist()):
                seq = 0
                source = parts(kind, batch.column(4)[k].as_py() or b"")
                while True:
                    try:
                        row = next(source, None)
                    except Exception as e:  # whatever a hostile file does
                        row, source = (0, "", None, None, False, False, None, f"could not be processed ({type(e).__name__})"), iter(())
                    if row is None:
                        break
                    rows.append((seq, *row))
                    take.append(k)
                    seq, size = seq + 1, size + len(row[6] or b"")
                    if size > SPLIT_BYTES:
                        yield out()
                        rows, take, size = [], [], 0
            if rows:
                yield out()

    return files.select(key, "kind", "strip_icc", "remove_scripts", "content").mapInArrow(run, f"`{key}` {own}, {PART}")


#: Ends of names of images in archives.
IMAGE_NAMES = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".webp")


def _told(found: Iterator[images.Piece]) -> Iterator[tuple]:
    """The fields of pieces; starts marks the first of an image."""
    return ((p.kind, k == 0, p.good, p.data) for k, p in enumerate(found))


def rewritten(parts: DataFrame, rules: dict = RULES, kinds: tuple[str, ...] = ("office", "odf", "svg", "image")) -> DataFrame:
    """parts with action, category (of an image's piece, where it goes), told (texts of the report), counts (by category), error and
    the new data. kinds: those of the files that may come; the others' patterns are left out of the plan."""
    kind, scripts, name, raw, action = F.col("kind"), F.col("remove_scripts"), F.col("part_name"), F.col("_raw"), F.col("action")
    df = parts.withColumns({"low": F.lower(name), "_raw": F.col("data"), "head": images.head(F.col("data"), F.col("format"))})
    archive = [k for k in ("office", "odf") if k in kinds]
    by_kind = lambda pick, rest: " ".join(f"when '{k}' then {packages.first(rules[k], pick, rest, 'remove_scripts')}" for k in archive)
    df = df.withColumns({"action": F.expr(f"case kind {by_kind('action', repr('keep'))} when 'image' then 'strip' when 'svg' then 'rewrite' else 'none' end"), "rule": F.expr(f"case kind {by_kind('category', 'null')} when '' then '' end")})
    goes = F.when(action == "strip", F.expr(images.rule(rules["image"])))
    df = df.withColumn("category", goes).withColumn("category", F.when((F.col("category") != "icc") | F.col("strip_icc"), F.col("category")))
    none, low, error = F.array().cast("array<string>"), F.col("low"), F.col("verdict")
    told, found, by_rewrite = none, {}, raw
    # chains of patterns, each over its own rows; a null passes them
    text = lambda k: F.when((kind == k) & (action == "rewrite"), lossless(raw))
    if "office" in kinds:
        df = packages.rewrite_ooxml(df.withColumn("data", text("office")), scripts).withColumnRenamed("new_data", "_office")
        core = told_fields("document properties", rw.fields(readable(raw), rw.CORE_FIELD))
        app = told_fields("app properties", rw.fields(readable(raw), rw.APP_FIELD))
        one = F.when(low == "docprops/core.xml", core).when(low == "docprops/app.xml", app).when(low == "docprops/custom.xml", F.lit("custom properties")).when(F.col("rule").isin(*INLINE), F.col("rule"))
        told = F.when(kind == "office", F.array_compact(F.array(one))).otherwise(told)
        found |= {"rsid": "n_rsid", "track changes": "n_track_changes", "comment ranges": "n_comment_ranges"}
        by_rewrite = F.when(kind == "office", F.encode("_office", "ISO-8859-1")).otherwise(by_rewrite)
    if "odf" in kinds:
        df = packages.rewrite_odf(df.withColumn("data", text("odf"))).withColumnRenamed("new_data", "_odf")
        one = F.when(low == "meta.xml", told_fields("document metadata", rw.odf_fields(readable(raw))))
        told = F.when(kind == "odf", F.array_compact(F.array(one))).otherwise(told)
        found |= {"changes": "n_changes", "annotations": "n_annotations", "settings": "n_settings"}
        by_rewrite = F.when(kind == "odf", F.encode("_odf", "ISO-8859-1")).otherwise(by_rewrite)
    if "svg" in kinds:
        good = F.coalesce(images.signature(raw, "svg"), F.lit(False))
        df = rw.scrub_markup(df.withColumn("_svg", F.when(kind == "svg", F.when(good, lossless(raw)))), "_svg")
        told = F.when((kind == "svg") & good, F.col("removed")).otherwise(told)
        by_rewrite = F.when((kind == "svg") & (F.size("removed") > 0), F.encode("_svg", "ISO-8859-1")).otherwise(by_rewrite)
        error = F.coalesce(error, F.when((kind == "svg") & ~good, F.lit("not a valid SVG file")))
    counts = F.create_map().cast("map<string,int>")
    if found:
        each = F.create_map(*[x for k, c in found.items() for x in (F.lit(k), F.coalesce(F.col(c), F.lit(0)).cast("int"))])
        counts = F.when(action == "rewrite", F.map_filter(each, lambda _, v: v > 0)).otherwise(counts)
    if archive:
        first = F.col("piece").isNull() | F.col("starts")
        counts = F.coalesce(F.when((action == "drop") & first & ~F.col("rule").isin(*INLINE, "unreported"), F.create_map("rule", F.lit(1))), counts)
        unsafe, refused = packages.unsafe_name(name), F.lit(None).cast("string")
        for k, v in REFUSED.items():
            refused = F.when(unsafe == k, f"document contains {v}").otherwise(refused)
        error = F.coalesce(error, F.when(kind.isin("office", "odf"), refused))
    new = F.when(action == "template", F.encode(packages.templated(name, F.lit("")), "UTF-8")).when(action == "rewrite", by_rewrite).when(action == "drop", F.lit(None)).otherwise(raw)
    return df.select(*[c for c in parts.columns if c not in ("data", "verdict")], "action", "category", told.alias("told"), counts.alias("counts"), error.alias("error"), new.alias("data"))


FOUND = "format string, new_content binary, inline array<string>, counts map<string,int>, place string, kinds array<string>, good boolean, error string"


def _packed(parts: DataFrame, key: str) -> DataFrame:
    """(key, kind, FOUND) of files whose parts follow each other. Entries are written into the copy as they come."""
    own = parts.schema[key].dataType.simpleString()

    class Copy:
        """The copy that is being made."""

        def __init__(self, row: dict, at: pa.Array):
            self.at, self.kind, self.format = at, row["kind"], row["format"]
            self.inline, self.counts, self.place, self.error, self.good = [], {}, None, None, True
            self.kinds: dict[str, None] = {}
            self.zip, self.data = archives.Packer() if self.kind in ("office", "odf") else None, None
            self.pieces, self.gone, self.name, self.last = [], set(), None, -1

        def add(self, r: dict) -> None:
            self.last = r["part_seq"]
            self.error = self.error or r["error"]
            if self.error:
                self.zip = None
                return
            if self.name is not None and (r["piece"] is None or r["starts"]):
                self._image()
            self.inline += [t for t in r["told"] if t not in self.inline]
            for k, n in r["counts"]:
                self.counts[k] = self.counts.get(k, 0) + n
            if r["piece"] is None:
                self._entry(r["part_name"], r["action"], r["data"])
                return
            self.name, self.action, self.own_format = r["part_name"], r["action"], r["format"]
            if r["category"] is None:
                if r["action"] != "drop":
                    self.pieces.append((r["piece"], r["data"], r["good"]))
            else:
                self.gone.add(r["piece"])
                if self.kind == "image":
                    self.counts[r["category"]] = self.counts.get(r["category"], 0) + 1
                if self.kind == "image" and r["category"] == "exif" and self.place is None and r["format"] != "webp":
                    found = images.gps(r["data"][4:] if r["format"] == "jpeg" else r["data"][8:-4])
                    self.place = found and images.gps_text(found)

        def _image(self) -> None:
            """The pieces that were open are one image."""
            data = images.joined(self.own_format, [(k, d) for k, d, _ in self.pieces], self.gone)
            if self.kind == "image":
                whole = [(k, g) for k, _, g in self.pieces if k != "gap" or not self.gone]
                self.good, self.kinds = all(g for _, g in whole), dict.fromkeys(k for k, _ in whole if k != "gap")
                self.data = data
            else:
                self.counts["images"] = self.counts.get("images", 0) + bool(self.gone)
                self._entry(self.name, self.action, data)
            self.pieces, self.gone, self.name = [], set(), None

        def _entry(self, name: str, action: str, data: bytes | None) -> None:
            if self.zip is None:
                self.data = data
            elif action != "drop":
                self.zip.add(name, data or b"")

        def done(self) -> tuple:
            if self.name is not None and not self.error:
                self._image()
            content = None if self.error else self.zip.done() if self.zip else self.data
            return self.kind, self.format, content, self.inline, list(self.counts.items()), self.place, list(self.kinds), self.good, self.error

    types = [pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.map_(pa.string(), pa.int32()), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
    names = [key, "kind", *(c.split()[0] for c in FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, size = None, [], 0

        def out() -> pa.RecordBatch:
            at = pa.concat_arrays([a for a, _ in made])
            return pa.RecordBatch.from_arrays([at, *(pa.array(c, t) for c, t in zip(zip(*(d for _, d in made)), types))], names=names)

        for batch in batches:
            names_in = [c for c in batch.schema.names if c != key]
            for k, values in enumerate(zip(*(batch.column(c).to_pylist() for c in names_in))):
                row = dict(zip(names_in, values))
                if now is None or row["part_seq"] <= now.last:  # numbers begin anew with each file
                    if now is not None:
                        made.append((now.at, now.done()))
                        size += len(made[-1][1][2] or b"") + 1000
                        if size > SPLIT_BYTES:
                            yield out()
                            made, size = [], 0
                    now = Copy(row, batch.column(key).slice(k, 1))
                now.add(row)
        if now is not None:
            made.append((now.at, now.done()))
        if made:
            yield out()

    return parts.mapInArrow(run, f"`{key}` {own}, kind string, {FOUND}")


def _removed(kinds: tuple[str, ...]) -> Column:
    """The report's texts in order, from kind, format, inline, counts and place."""
    removed = F.col("inline")
    for kind, listed in COUNTERS.items():
        if kind in kinds:
            counted = F.array_compact(F.array(*[_counted(F.coalesce(F.element_at("counts", c), F.lit(0)), *told) for c, *told in listed]))
            removed = F.when(F.col("kind") == kind, F.concat("inline", counted)).otherwise(removed)
    return F.when(F.col("kind") == "image", images.told(F.col("format"), F.col("counts"), F.col("place"))).otherwise(removed)


def _cleaned(files: DataFrame, key: str, rules: dict = RULES, kinds: tuple[str, ...] = ("office", "odf", "svg", "image"), **limits: int) -> DataFrame:
    """(key, DONE, place) of files (key, kind, strip_icc, remove_scripts, content) of these kinds, or of none of them."""
    done = _packed(rewritten(_split(files, key, **limits), rules, kinds), key)
    removed = _removed(kinds)
    corrupt = F.when((F.col("kind") == "image") & ~images.sound(F.col("format"), F.col("kinds"), F.col("good")), F.lit("corrupt image"))
    done = done.withColumn("error", F.coalesce("error", corrupt))
    fine = F.col("error").isNull()
    done = done.withColumns({"removed": F.when(fine, removed).otherwise(F.array().cast("array<string>")), "new_content": F.when(fine, F.col("new_content")), "place": F.when(fine, F.col("place"))})
    status = F.when(~fine, "error").when(F.size("removed") > 0, "ok").otherwise("clean")
    return done.select(key, "new_content", "removed", status.alias("status"), "error", "place", "kind")


def _typed(files: DataFrame, key: str, kind: Column | str, options: Options) -> DataFrame:
    return files.select(key, (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), F.lit(options.strip_icc).alias("strip_icc"), F.lit(options.remove_scripts).alias("remove_scripts"), "content")


def clean_packages(files: DataFrame, kind: str, options: Options = Options(), key: str = "path", **limits: int) -> DataFrame:
    """(key, DONE) of office or odf archives in (key, content). An archive over a limit, with an unsafe entry name, encrypted, or
    that is none is an error row without bytes."""
    return _cleaned(_typed(files, key, kind, options), key, kinds=(kind,), **limits).drop("place", "kind")


def _counted(n: Column, *texts: str) -> Column:
    many = F.concat(*[x for k, t in enumerate(texts[-1].split("{}")) for x in ([n.cast("string")] if k else []) + [F.lit(t)]])
    return F.when(n > 0, F.when(n == 1, texts[0]).otherwise(many) if len(texts) > 1 else many)


def clean_svg(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, DONE) of SVG files in (key, content), by built-in functions alone; other bytes than those removed stay as they are."""
    good = F.coalesce(images.signature(F.col("content"), "svg"), F.lit(False))
    df = rw.scrub_markup(files.select(key, "content", F.when(good, lossless(F.col("content"))).alias("_t")), "_t")
    new = F.when(F.size("removed") > 0, F.encode("_t", "ISO-8859-1")).otherwise(F.col("content"))
    return df.select(key, F.when(good, new).alias("new_content"), "removed", F.when(good, F.col("status")).otherwise("error").alias("status"), F.when(~good, "not a valid SVG file").alias("error"))


def strip_images(files: DataFrame, options: Options = Options(), key: str = "doc_id", rules: dict = RULES) -> DataFrame:
    """(key, DONE, place) of JPEG, PNG and WebP files in (key, content), whatever their names are; place is the first GPS position. A
    file that is no sound image is an error row with a general message and no bytes; one bad file stops no other."""
    return _cleaned(_typed(files, key, "image", options), key, rules, ("image",)).drop("kind")


def _named_error(error: Column, path: Column) -> Column:
    """The error of a file of another kind names what its extension says."""
    name = F.element_at(F.create_map(*[F.lit(x) for pair in {".png": "PNG", ".webp": "WebP"}.items() for x in pair]), F.lower(paths.ext(path)))
    return F.when(error == "not a valid image", F.concat(F.lit("not a valid "), F.coalesce(name, F.lit("JPEG")), F.lit(" file"))).otherwise(error)


def clean_images(files: DataFrame, options: Options = Options(), key: str = "path") -> DataFrame:
    """(key, DONE) of JPEG, PNG and WebP files in (key, content)."""
    return strip_images(files, options, key).withColumn("error", _named_error(F.col("error"), F.col(key).cast("string"))).drop("place")


def _routed(files: DataFrame, options: Options) -> DataFrame:
    """files (file: path, error and size; kind, strip_icc, remove_scripts, content), told by their paths and sizes."""
    low, size = F.lower(paths.ext(F.col("path"))), F.coalesce(F.octet_length("content"), F.lit(0))
    unread = F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")
    error = F.coalesce(unread, F.when(size > fs.MAX_BYTES, F.concat(F.lit("file too large: "), paths.base(F.col("path")))))
    kind = F.when(error.isNotNull(), "error").when(low == ".svg", "svg").when(low.isin(".png", ".webp", *JPEG), "image")
    kind = kind.when(low.isin(*paths.FORMATS["office"]), "office").when(low.isin(*paths.FORMATS["odf"]), "odf").otherwise("other")
    given = files.schema["options"].dataType.fieldNames() if "options" in files.columns else []
    own = lambda name: (F.coalesce(F.col(f"options.{name}"), F.lit(getattr(options, name))) if name in given else F.lit(getattr(options, name))).alias(name)
    return files.select(F.struct("path", error.alias("error"), F.octet_length("content").cast("long").alias("size")).alias("file"), kind.alias("kind"), own("strip_icc"), own("remove_scripts"), "content")


def clean_files(files: DataFrame, options: Options = Options(), rules: dict = RULES) -> DataFrame:
    """(path, new_content, removed, notes, status, error, place, src_size, out_size) of each file in (path, content), in one pass: files are read once,
    and each family's rules and patterns see its own parts only. place is the first GPS position in an image.

    A struct column ``options`` with some of strip_icc and remove_scripts gives a file its own; a null field or none stands for
    ``options``. A column ``read_error`` (the error of ``sources.files.read``) tells what could not be read. The extension tells what a
    file is. Formats that need a codec or a parser, and unsupported ones, are skipped; a file over the size limit, a null
    content, and what is not what its extension says are error rows without bytes. One bad file stops no other; repeated
    paths are cleaned each; other columns are ignored; no files give no rows. Nothing is shuffled."""
    done = _cleaned(_routed(files, options), "file", rules)
    path, kind = F.col("file.path"), F.col("kind")
    skipped = F.coalesce(paths.unsupported(path), F.concat(F.lower(paths.ext(path)), F.lit(" needs a codec or a parser")))
    error = F.when(kind == "error", F.col("file.error")).when(kind == "other", skipped).otherwise(_named_error(F.col("error"), path))
    status = F.when(kind == "error", "error").when(kind == "other", "skipped").otherwise(F.col("status"))
    notes = F.when(status == "clean", F.array(F.lit("no metadata found"))).otherwise(F.array().cast("array<string>"))
    return done.select(path.alias("path"), "new_content", "removed", notes.alias("notes"), status.alias("status"), error.alias("error"), "place", F.col("file.size").alias("src_size"), F.octet_length("new_content").cast("long").alias("out_size"))


def findings(files: DataFrame, options: Options = Options(), rules: dict = RULES) -> DataFrame:
    """(path, kind, format, ord, entry, part_name, category, hits, text, nth, position) of what goes from files (path, content): a row for each finding
    in a part, in order by ord and nth. text: what the report tells of it as it stands; position: the GPS position in an Exif piece.
    Bytes are not packed again, and only Exif pieces go on to the helper that reads them. Files with an error are not left out."""
    parts = rewritten(_split(_routed(files, options), "file"), rules)
    row = lambda category, hits, text, nth=F.lit(0): F.struct(category.alias("category"), hits.cast("int").alias("hits"), text.cast("string").alias("text"), nth.cast("int").alias("nth"))
    told = F.transform("told", lambda t, i: row(F.lit("told"), F.lit(1), t, i))
    counted = F.transform(F.map_entries("counts"), lambda e: row(e["key"], e["value"], F.lit(None)))
    piece = F.when(F.col("category").isNotNull(), F.array(row(F.col("category"), F.lit(1), F.lit(None)))).otherwise(F.array().cast("array<struct<category:string,hits:int,text:string,nth:int>>"))
    exif = F.when((F.col("category") == "exif") & (F.col("format") != "webp"), F.substring("data", F.when(F.col("format") == "jpeg", 5).otherwise(9), F.octet_length("data")))
    found = parts.select(F.col("file.path").alias("path"), "kind", "format", F.col("part_seq").alias("ord"), "entry", "part_name", exif.alias("content"), F.explode(F.concat(told, counted, piece)).alias("x")).select("*", "x.*").drop("x")
    found = images.gps_of(found).withColumn("position", texts.gps_text(F.col("lat"), F.col("lat_ref"), F.col("lon"), F.col("lon_ref")))
    return found.drop("lat", "lat_ref", "lon", "lon_ref", "identity")


def removed_lists(found: DataFrame) -> DataFrame:
    """(path, removed, place) from findings, for each path with one: texts that stand in parts once each, in order; then counts by category,
    an image in an archive as one, whatever it lost; and the first position."""
    key, nested = ["path", "kind"], F.col("format").isNotNull() & (F.col("kind") != "image")
    category, one = F.when(nested, F.lit("images")).otherwise(F.col("category")), F.when(nested, F.col("entry"))
    each = found.groupBy(*key, category.alias("category"), "text", one.alias("one")).agg(F.min(F.struct("ord", "nth")).alias("ord"), F.sum("hits").alias("n"), F.max(F.when(F.col("kind") == "image", F.col("format"))).alias("format"), F.min(F.when(F.col("position").isNotNull(), F.struct("ord", "position"))).alias("at"))
    each = each.groupBy(*key, "category", "text").agg(F.min("ord").alias("ord"), F.sum(F.when(F.col("one").isNotNull(), 1).otherwise(F.col("n"))).cast("int").alias("n"), F.max("format").alias("format"), F.min("at").alias("at"))
    inline = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))), lambda x: x["text"])
    counts = F.map_from_entries(F.collect_list(F.when(F.col("text").isNull(), F.struct("category", "n"))))
    rows = each.groupBy(*key).agg(inline.alias("inline"), counts.alias("counts"), F.max("format").alias("format"), F.min("at")["position"].alias("place"))
    return rows.select("path", _removed(("office", "odf", "svg", "image")).alias("removed"), F.when(F.col("kind") == "image", F.col("place")).alias("place"))


#: Extensions of JPEG files.
JPEG = (".jpg", ".jpeg", ".jpe", ".jfif")
