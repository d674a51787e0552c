"""Whole files: what goes, what stays byte by byte, what is refused, and the report."""

import io
import random
import zipfile

import pytest
from test_files import FRAME, PLAIN, SCAN, SEG, gps_blob

from metascrub.functions import texts
from metascrub.operators import clean, packages, reports
from metascrub.sources import files

DIRTY = PLAIN[:2] + SEG("FFE1", b"Exif\0\0" + gps_blob("MM")) + PLAIN[2:]


def packed(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def unpacked(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist()]


def run(spark, rows, options=clean.Options()):
    table = spark.createDataFrame([(p, None if c is None else bytearray(c), "own") for p, c in rows], "path string, content binary, error string")
    return {r.path: r for r in clean.clean_files(table.repartition(3), options).collect()}


def test_office(spark):
    """Comments, properties, ids, macros and images go; other bytes, also those that are no UTF-8, stay."""
    body = b'<w:p w:rsidR="00A1"><w:ins w:author="Jane" w:date="2020">caf\xe9 \xff\x00</w:ins></w:p>'
    source = packed(
        ("[Content_Types].xml", b'<Types><Override PartName="/word/vbaProject.bin"/><Override PartName="/word/document.xml"/></Types>'), ("docProps/core.xml", b"<cp:x><dc:creator>Jane \xff Doe</dc:creator><dc:title> </dc:title></cp:x>"),
        ("word/document.xml", body), ("word/comments.xml", b"c"), ("word/commentAuthors.xml", b"a"), ("xl/authors.xml", b"a"), ("word/vbaProject.bin", b"v"), ("word/media/i.jpg", DIRTY), ("word/media/j.jpg", PLAIN), ("word/folder/", b""), ("other.bin", bytes(range(256))),
    )
    got = run(spark, [("d/a.docx", source), ("d/b.DOCX", packed(("x.txt", b"x")))])
    a = got["d/a.docx"]
    parts = dict(unpacked(a.new_content))
    assert list(parts) == ["[Content_Types].xml", "docProps/core.xml", "word/document.xml", "word/media/i.jpg", "word/media/j.jpg", "other.bin"]
    assert parts["word/document.xml"] == b"<w:p><w:ins>caf\xe9 \xff\x00</w:ins></w:p>" and parts["other.bin"] == bytes(range(256)) and parts["word/media/i.jpg"] == parts["word/media/j.jpg"] == PLAIN
    assert parts["[Content_Types].xml"] == b'<Types><Override PartName="/word/document.xml"/></Types>' and parts["docProps/core.xml"].decode() == packages.TEMPLATES["docprops/core.xml"]
    assert a.status == "ok" and a.removed == ["document properties (creator)", "document comments", "comment author list", "VBA macro project removed", "1 edit-session ID(s) removed (rsid)", "metadata in 1 embedded image(s)", "2 track-change author attribution(s) removed"]
    assert a.out_size == len(a.new_content) and (got["d/b.DOCX"].status, got["d/b.DOCX"].notes) == ("clean", ["no metadata found"])
    with zipfile.ZipFile(io.BytesIO(a.new_content)) as z:
        assert {(i.date_time, i.create_system, i.external_attr) for i in z.infolist()} == {((1980, 1, 1, 0, 0, 0), 0, 0)}
    kept = run(spark, [("a.docx", source)], clean.Options(remove_scripts=False))["a.docx"]
    assert dict(unpacked(kept.new_content))["word/vbaProject.bin"] == b"v" and "VBA macro project removed" not in kept.removed


def test_odf(spark):
    source = packed(("mimetype", b"application/vnd.oasis.opendocument.text"), ("meta.xml", b"<dc:creator>J\xfcrgen</dc:creator>"), ("content.xml", b'a<text:change dc:creator="x"/>\xe4<text:annotation>who</text:annotation>b'), ("Thumbnails/t.png", b"t"), ("Basic/s.xml", b"s"))
    got = run(spark, [("a.odt", source), ("b.ods", packed(("mimetype", b"m"), ("Thumbnails/t.png", b"t")))])
    parts = dict(unpacked(got["a.odt"].new_content))
    assert list(parts) == ["mimetype", "meta.xml", "content.xml"] and parts["content.xml"] == b"a\xe4b" and b"J" not in parts["meta.xml"].replace(b"xml", b"")
    assert got["a.odt"].removed == ["document metadata (creator)", "1 macro part(s) removed", "1 track-change field(s) removed", "1 annotation(s) removed"]
    assert got["b.ods"].status == "clean" and [n for n, _ in unpacked(got["b.ods"].new_content)] == ["mimetype"]


def test_images_and_svg(spark):
    svg = b'<?xml version="1.0"?><SVG>\xe9<!-- me --><svg></svg></SVG>'
    got = run(spark, [("a.jpg", DIRTY), ("b.svg", svg), ("c.svg", b"no markup"), ("d.png", b"x"), ("e.webp", b"RIFF"), ("f.jpg", PLAIN), ("g.svg", b"<svg>\xff</svg>"), ("h.jpg", FRAME + SCAN), ("i.svg", None)])
    assert bytes(got["a.jpg"].new_content) == PLAIN and got["a.jpg"].removed[1].startswith("GPS location")
    assert bytes(got["b.svg"].new_content) == svg.replace(b"<!-- me -->", b"") and got["b.svg"].removed == ["1 comment(s)"]
    assert bytes(got["f.jpg"].new_content) == PLAIN and got["f.jpg"].status == "clean" and bytes(got["g.svg"].new_content) == b"<svg>\xff</svg>"
    assert {p: got[p].error for p in ("c.svg", "d.png", "e.webp", "h.jpg", "i.svg")} == {"c.svg": "not a valid SVG file", "d.png": "not a valid PNG file", "e.webp": "not a valid WebP file", "h.jpg": "not a valid JPEG file", "i.svg": "not a valid SVG file"}
    assert all(got[p].new_content is None and got[p].status == "error" for p in ("c.svg", "d.png", "e.webp", "h.jpg", "i.svg"))


@pytest.mark.parametrize(("name", "why"), [("../x", "path-traversal"), ("/etc/x", "absolute-path"), ("c:x", "drive-letter"), ("n" * 600, "suspicious"), ("a\\..\\b", "path-traversal")])
def test_unsafe_names(spark, name, why):
    got = run(spark, [("a.docx", packed(("ok.xml", b"x"), (name, b"y"), ("z.xml", b"z"))), ("b.docx", packed(("ok.xml", b"x")))])
    assert got["a.docx"].status == "error" and why in got["a.docx"].error and got["a.docx"].new_content is None and not got["a.docx"].removed
    assert got["b.docx"].status == "clean"


def test_hostile_archives(spark):
    """A bad archive, whatever is wrong and wherever, is one error row and touches no neighbour."""
    good = packed(("a.xml", b'<a w:rsidR="1"/>' * 50), ("b.xml", b"b" * 500))
    broken = bytearray(packed(("a.xml", b"x" * 300), ("b.xml", b"y" * 300)))
    broken[broken.index(b"y" * 300) + 5] ^= 1  # the checksum of the second entry is wrong
    rows = [(f"{i}.docx", c) for i, c in enumerate([good, bytes(broken), good, b"junk", None, packed(), good])]
    got = run(spark, rows)
    assert [got[f"{i}.docx"].status for i in range(7)] == ["ok", "error", "ok", "error", "error", "error", "ok"]
    assert len(got) == 7 and all(got[f"{i}.docx"].new_content is None for i in (1, 3, 4, 5))
    table = spark.createDataFrame([("a.docx", bytearray(good))], "path string, content binary")
    assert clean.clean_packages(table, "office", max_total=600).first().error == "archive too large"
    assert clean.clean_files(table.limit(0)).count() == 0


def test_duplicate_names(spark):
    with pytest.warns(UserWarning, match="Duplicate"):
        source = packed(("a.xml", b"first"), ("b.xml", b"b"), ("a.xml", b"last"))
    assert unpacked(run(spark, [("a.docx", source)])["a.docx"].new_content)[0][1] == b"last"


def test_skipped(spark):
    got = run(spark, [("a.txt", b"x"), ("b", b"x"), ("c.pdf", b"%PDF"), ("d.gif", b"GIF8")])
    assert all(r.status == "skipped" and r.new_content is None for r in got.values())
    assert got["a.txt"].error == "unsupported file type: .txt" and got["b"].error == "unsupported file type: (none)" and got["d.gif"].error == ".gif needs a codec or a parser"


def test_readable(spark):
    raw = spark.createDataFrame([(bytearray(b"a\xff\xe9b\xc3\xa9"),)], "data binary")
    assert raw.select(clean.readable(raw["data"]).alias("t")).first().t == "abé"
    assert raw.select(clean.lossless(raw["data"]).alias("t")).first().t == b"a\xff\xe9b\xc3\xa9".decode("latin-1")
    assert texts.DEFAULTS["suffix"] == clean.Options().suffix


def test_names_brute_force(spark):
    """Hot names under one root, free numbers between those that are taken."""
    r = random.Random(4)
    rows = [(f"root/{r.randrange(9)}/d{i}/x.png", r.choice(["ok", "clean", "error"])) for i in range(200)] + [(f"q/y{i}.png", "ok") for i in range(3)]
    taken = {"o/x_clean.png"} | {f"o/x_clean_{k}.png" for k in r.sample(range(1, 300), 120)} | {"o/x_clean_01.png", "o/y1_clean.png"}
    want, used = {}, set(taken)
    for path, status in sorted(rows):
        head = f"o/{path.split('/')[-1][:-4]}_clean"
        dst, k = f"{head}.png", 0
        while status != "error" and dst in used:
            k += 1
            dst = f"{head}_{k}.png"
        used |= {dst} if status != "error" else set()
        want[path] = dst
    got = reports.name_outputs(spark.createDataFrame(rows, "path string, status string"), spark.createDataFrame([(t,) for t in taken], "path string"), out_dir="o")
    assert {x.path: x.dst for x in got.collect()} == want


def test_report_files(spark, tmp_path):
    lines = reports.report_lines(spark.createDataFrame([("a/x.png", "ok", None)], "path string, status string, details string"))
    files.write_report(lines, str(tmp_path / "one"), one_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    with pytest.raises(ValueError, match="at most"):
        files.write_report(lines, str(tmp_path / "two"), one_file=True, most=3)


def mixed():
    office = packed(("docProps/core.xml", b"<dc:creator>J</dc:creator>"), ("word/document.xml", b'<w:p w:rsidR="1"/>'), ("word/comments.xml", b"c"), ("word/media/i.jpg", DIRTY), ("word/media/j.jpg", DIRTY), ("word/vbaProject.bin", b"v"))
    odf = packed(("mimetype", b"m"), ("meta.xml", b"<dc:creator>J</dc:creator>"), ("Pictures/i.jpg", DIRTY), ("Basic/x", b"s"))
    return [("a.docx", office), ("b.odt", odf), ("c.jpg", DIRTY), ("d.svg", b"<svg><!-- me --><metadata>x</metadata></svg>"), ("e.txt", b"x"), ("f.png", b"no"), ("g.docx", b"no"), ("h.jpeg", PLAIN)]


def test_one_pass(spark):
    """A mixed folder: one scan and two helpers, no shuffle; the findings give the same lists as the cleaning."""
    table = spark.createDataFrame([(p, bytearray(c)) for p, c in mixed()], "path string, content binary")
    done = clean.clean_files(table)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Scan") == 1 and "Exchange" not in plan
    got = {r.path: r for r in done.collect()}
    lists = {r.path: (r.removed, r.place) for r in clean.removed_lists(clean.findings(table)).collect()}
    assert {p: (r.removed, r.place) for p, r in got.items() if r.removed} == lists and len(lists) == 4
    assert got["a.docx"].removed == ["document properties (creator)", "document comments", "VBA macro project removed", "1 edit-session ID(s) removed (rsid)", "metadata in 2 embedded image(s)"]
    assert dict(unpacked(got["b.odt"].new_content))["Pictures/i.jpg"] == DIRTY and got["c.jpg"].place == "31°57'0\"S, 115°51'2\"E"
    assert [got[p].status for p in ("e.txt", "f.png", "g.docx", "h.jpeg")] == ["skipped", "error", "error", "clean"]


def test_options_by_file(spark):
    """Equal bytes with different options come out differently, in one pass."""
    icc = SEG("FFE2", b"ICC_PROFILE\0x")
    image, macros = PLAIN[:2] + icc + PLAIN[2:], packed(("word/vbaProject.bin", b"v"))
    rows = [(f"{i}.{e}", bytearray(c), o) for e, c in (("jpg", image), ("docx", macros)) for i, o in enumerate([(True, False), (False, True), (None, None), None])]
    table = spark.createDataFrame(rows, "path string, content binary, options struct<strip_icc:boolean,remove_scripts:boolean>")
    got = {r.path: r for r in clean.clean_files(table).collect()}
    assert [bytes(got[f"{i}.jpg"].new_content) == PLAIN for i in range(4)] == [True, False, False, False]
    assert [got[f"{i}.docx"].removed for i in range(4)] == [[], *[["VBA macro project removed"]] * 3]
    own = table.withColumn("options", texts.options(table["path"]))  # no JSON: the defaults
    assert clean.clean_files(own).filter("path = '0.jpg'").first().status == "clean"


def test_folder_to_folder(spark, tmp_path):
    """Files of any names in, cleaned copies under their names out, originals as they were."""
    for name, content in [*mixed(), (".hidden/_k.jpg", DIRTY)]:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    root = str(tmp_path / "in")
    table = files.read(files.walk(spark, root)).withColumnRenamed("error", "read_error")
    done = clean.clean_files(table).cache()
    named = reports.name_outputs(done.select("path", "status"), spark.createDataFrame([], "path string"), out_dir=str(tmp_path / "out"))
    assert files.write_copies(done.filter("status in ('ok', 'clean')").join(named.select("path", "dst"), "path").select("dst", done["new_content"].alias("content")), str(tmp_path / "out")) == 6
    assert (tmp_path / "out/c_clean.jpg").read_bytes() == PLAIN == (tmp_path / "out/_k_clean.jpg").read_bytes()
    assert all((tmp_path / "in" / name).read_bytes() == content for name, content in mixed())
