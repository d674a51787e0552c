"""What SQL cannot say: hostile images and archives, naming, sinks."""

import io
import struct
import zipfile
import zlib

import pytest

from metascrub.operators import archives, clean, images, reports
from metascrub.sources import files

SEG = lambda mark, body: bytes.fromhex(mark) + struct.pack(">H", len(body) + 2) + body
FRAME, SCAN = bytes.fromhex("FFC0000B080001000101011100"), bytes.fromhex("FFDA0008010100003F00") + b"scan" + b"\xff\xd9"
PLAIN = b"\xff\xd8" + SEG("FFE0", b"JFIF\0") + FRAME + SCAN


def gps_blob(order):
    e = {"II": "<", "MM": ">"}[order]
    head = order.encode() + struct.pack(e + "HI", 42, 8)
    main = struct.pack(e + "HHHII", 1, 0x8825, 4, 1, 26) + b"\0" * 4
    entry = lambda tag, kind, n, value: struct.pack(e + "HHI", tag, kind, n) + value
    where = struct.pack(e + "H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack(e + "I", 80)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack(e + "I", 104)) + b"\0" * 4
    return head + main + where + struct.pack(e + "6I", 31, 1, 57, 1, 1, 2) + struct.pack(e + "6I", 115, 1, 51, 1, 3, 2)


@pytest.mark.parametrize("order", ["II", "MM"])
def test_gps(order):
    blob = gps_blob(order)
    assert images.gps_text(images.gps(blob)) == "31°57'0\"S, 115°51'2\"E"
    assert images.gps(b"Exif\0\0" + blob) == images.gps(blob)
    for cut in range(len(blob)):
        images.gps(blob[:cut])


@pytest.mark.parametrize("blob", [b"", b"II", b"XX*\0\0\0\0\0", b"II*\0\xff\xff\xff\xff", b"MM\0*\0\0\0\x08\xff\xff", b"II*\0\x08\0\0\0\x01\0\x25\x88\x04\0\x01\0\0\0\xff\xff\xff\x7f"])
def test_hostile_exif(blob):
    assert images.gps(blob) is None


def stripped(spark, *contents, strip_icc=False):
    """(bytes, removed, error) of each content."""
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(contents)], "doc_id int, content binary")
    return [(r.new_content and bytes(r.new_content), r.removed, r.error) for r in sorted(clean.strip_images(df, clean.Options(strip_icc=strip_icc)).collect())]


def test_jpeg(spark):
    icc = SEG("FFE2", b"ICC_PROFILE\0x")
    full = PLAIN[:2] + SEG("FFE1", b"Exif\0\0" + gps_blob("MM")) + SEG("FFE1", b"http://ns.adobe.com/xap/1.0/\0x") + SEG("FFFE", b"c") + SEG("FFED", b"Photoshop 3.0\0") + SEG("FFEE", b"Adobe") + icc + PLAIN[2:]
    fill = full[:2] + b"\xff" + full[2:]
    [(new, removed, _), same] = stripped(spark, full, fill)
    assert new == PLAIN[:2] + SEG("FFEE", b"Adobe") + icc + PLAIN[2:] and same == (new, removed, None)
    assert removed == ["EXIF metadata", "GPS location (31°57'0\"S, 115°51'2\"E)", "XMP metadata", "embedded comment", "Photoshop metadata (layers/paths/IPTC)"]
    filled = PLAIN[:2] + b"\xff\xff" + PLAIN[2:]
    assert stripped(spark, new, PLAIN + b"after", PLAIN[:20], filled) == [(new, [], None), (PLAIN + b"after", [], None), (None, [], "corrupt image"), (filled, [], None)]
    assert stripped(spark, new, strip_icc=True) == [(new.replace(icc, b""), ["ICC color profile"], None)]


def test_png_and_webp(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    plain = [images.PNG_SIGNATURE, chunk(b"IHDR", b"\0" * 13), chunk(b"IDAT", b"x"), chunk(b"IEND", b"")]
    full = b"".join([*plain[:2], chunk(b"tEXt", b"Author"), chunk(b"eXIf", gps_blob("II")), plain[2], plain[3]]) + b"after"
    whole = b"".join(plain)
    [(new, removed, _), bad, cut] = stripped(spark, full, whole.replace(b"IDATx", b"IDATy"), whole[:20])
    assert new == whole and removed[0] == "1 text chunk(s)" and removed[2].startswith("GPS")
    assert bad == cut == (None, [], "corrupt image")
    piece = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    webp = lambda *p: b"RIFF" + struct.pack("<I", 4 + sum(map(len, p))) + b"WEBP" + b"".join(p)
    plain = webp(piece(b"VP8X", b"\0" * 10), piece(b"VP8 ", b"abc"))
    dirty = webp(piece(b"VP8X", b"\x18" + b"\0" * 9), piece(b"VP8 ", b"abc"), piece(b"EXIF", b"e"), piece(b"XMP ", b"x"))
    assert stripped(spark, dirty, plain, plain[:-9], None) == [(plain, ["EXIF metadata", "XMP metadata"], None), (plain, [], None), (None, [], "corrupt image"), (None, [], "not a valid image")]


def test_own_rules(spark):
    """Rules are data: another table keeps comments and drops the picture's Adobe segment."""
    own = {**images.RULES, "jpeg": [images.Rule("piece = 'FE'", "keep", "picture"), images.Rule("piece = 'EE'", "drop", "other"), *images.RULES["jpeg"]]}
    full = PLAIN[:2] + SEG("FFFE", b"c") + SEG("FFEE", b"Adobe") + PLAIN[2:]
    df = spark.createDataFrame([(1, bytearray(full))], "doc_id int, content binary")
    got = clean.strip_images(df, rules={**clean.RULES, "image": own}).first()
    assert bytes(got.new_content) == PLAIN[:2] + SEG("FFFE", b"c") + PLAIN[2:] and got.removed == ["1 other embedded block(s)"]


def test_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", b"x" * 100)
        z.writestr("b/", b"")
        z.writestr("c.xml", b"y" * 50)
    good = out.getvalue()
    assert [r[3] for r in archives.entries(good)] == [None] * 3
    assert list(archives.entries(good, max_entries=2))[-1][3] == "too many entries"
    assert list(archives.entries(good, max_entry=60))[-1][3] == "entry too large"
    assert list(archives.entries(good, max_total=120))[-1][3] == "archive too large"
    assert list(archives.entries(b"junk"))[-1][3] == "not a valid archive"
    flagged = bytearray(good)
    flagged[good.index(b"PK\x01\x02") + 8] |= 1
    assert list(archives.entries(bytes(flagged)))[-1][3] == "encrypted"
    parts = archives.unzip_parts(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "k int, content binary"), "k")
    assert sorted((r.k, r.verdict) for r in parts.collect()) == [(1, None)] * 3 + [(2, "not a valid archive"), (3, "not a valid archive")]
    packed = archives.pack_zip(parts.filter("k = 1"), "k").first()["content"]
    with zipfile.ZipFile(io.BytesIO(packed)) as z:
        assert [(i.filename, i.date_time, i.create_system, i.external_attr) for i in z.infolist()] == [("a.xml", archives.EPOCH, 0, 0), ("c.xml", archives.EPOCH, 0, 0)]


def test_names(spark):
    rows = spark.createDataFrame([("a/x.png", "ok"), ("b/x.png", "ok"), ("c/x.png", "error"), ("d/x.png", "clean"), ("e/.hid", "ok")], "path string, status string")
    taken = spark.createDataFrame([("o/x_clean_1.png",), ("o/other.png",)], "path string")
    got = {r.path: r.dst for r in reports.name_outputs(rows, taken, out_dir="o").collect()}
    assert got == {"a/x.png": "o/x_clean.png", "b/x.png": "o/x_clean_2.png", "c/x.png": "o/x_clean.png", "d/x.png": "o/x_clean_3.png", "e/.hid": "o/.hid_clean"}


def test_discover_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/one.jpg").write_bytes(PLAIN)
    (tmp_path / "in/sub/two.jpg").write_bytes(PLAIN)
    found = files.discover(spark, str(tmp_path / "in"), content=True)
    assert found.count() == 2
    outputs = clean.strip_images(found, key="path").selectExpr("path", "path as dst", "new_content as content")
    files.write_outputs(outputs, str(tmp_path / "out"))
    assert [bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [PLAIN] * 2
    files.write_report(reports.report_lines(spark.createDataFrame([("a/x.png", "ok", None)], "path string, status string, details string")), str(tmp_path / "report"))
    lines = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "  x.png" in lines and "Total files: 1   (ok: 1)" in lines


def tiff(*pages, order="MM", loop=None):
    """Pages as lists of (tag, type, count, value or place); values of over four bytes stand behind the directories."""
    e = {"II": "<", "MM": ">"}[order]
    sizes = [2 + 12 * len(p) + 4 for p in pages]
    starts = [8 + sum(sizes[:k]) for k in range(len(pages))]
    out = order.encode() + struct.pack(e + "HI", 42, 8)
    for k, p in enumerate(pages):
        out += struct.pack(e + "H", len(p)) + b"".join(struct.pack(e + "HHI", *x[:3]) + x[3] for x in p)
        out += struct.pack(e + "I", starts[k + 1] if k + 1 < len(pages) else starts[loop] if loop is not None else 0)
    return out


@pytest.mark.parametrize("order", ["II", "MM"])
def test_tiff_directories(spark, order):
    """Tags of the second page and of directories below are found; chains and directories that lead back end."""
    e = {"II": "<", "MM": ">"}[order]
    n = lambda v: struct.pack(e + "I", v)
    plain = (256, 3, 1, b"\0\1\0\0")
    two = tiff([plain], [(315, 2, 2, b"J\0\0\0")], order=order, loop=0)
    sub = tiff([plain, (0x014A, 4, 1, n(8 + 2 + 24 + 4 + 2 + 12 + 4)), ][:2], [(305, 2, 2, b"S\0\0\0")], order=order)
    sub += struct.pack(e + "H", 2) + struct.pack(e + "HHI", 306, 2, 2) + b"D\0\0\0" + struct.pack(e + "HHI", 0x8769, 4, 1) + n(8) + n(0)
    hostile = [b"", b"II*\0", two[:20], b"MM\0*\xff\xff\xff\xff", bytes(range(64))]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate([two, sub, *hostile])], "k int, content binary")
    rows = images.directory_rows(df)
    got = {(r.k, r.directory, r.tag, bytes(r.value)) for r in images.identity(rows).collect()}
    assert got == {(0, "1", 315, b"J\0"), (1, "1", 305, b"S\0"), (1, "0/sub0", 306, b"D\0")}
    assert rows.filter("k = 0").count() == 2 and not rows.filter("k = 2 or k = 3").count()
    for cut in range(len(sub)):
        list(images.directories(sub[:cut]))
    assert [x[0] for x in images.directories(gps_blob(order))] == ["0"] + ["0/gps"] * 4


def test_rule_index(spark):
    """Rule tables against trying each rule; the plan has no nested loop and no window."""
    import random

    from metascrub.operators import packages

    r = random.Random(1)
    word = lambda k: "".join(r.choice("ab/") for _ in range(k))
    rules = [(word(r.randint(0, 6)), r.choice([None, 1, 2, 3]), r.choice(["drop", "keep", "strip"])) for _ in range(120)]
    names = [(k, word(r.randint(0, 9)).upper()) for k in range(500)]
    df = spark.createDataFrame(names, "k int, part_name string").unionByName(spark.createDataFrame([(500, None)], "k int, part_name string"))
    for table in (rules, rules[:1], [], [("aa", 1, "drop")] * 2):
        found = packages.first_match(df, spark.createDataFrame(table, "prefix string, priority int, action string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Window" not in plan and "Cartesian" not in plan
        want = {k: min(((p is None, p or 0, a) for x, p, a in table if n.lower().startswith(x)), default=(0, 0, "keep"))[2] for k, n in names} | {500: "keep"}
        assert {x.k: x.action for x in found.collect()} == want


def test_pdf_objects(spark):
    """Rings end, shared objects stay, levels are least, and depth is bounded."""
    from metascrub.operators import pdf_objects

    edges = [(1, "/Pages", 2), (2, "/Kids", 3), (3, "/Parent", 2), (3, "/A", 4), (4, "/Next", 5), (5, "/Next", 4), (3, "/Font", 6), (4, "/F", 6), (1, "/Metadata", 7), (7, "/X", 8), (9, "/Y", 1), (3, "/Font", 6)]
    df = spark.createDataFrame([("f", *x) for x in edges] + [("g", 1, "/Metadata", 2), ("h", 1, "/P", 1)], "path string, obj int, key string, target int")
    roots = df.select("path").distinct().selectExpr("path", "1 as obj")
    gone = df.filter("key = '/Metadata'").unionByName(pdf_objects.code_actions(df, spark.createDataFrame([("f", 4)], "path string, obj int"), ["path"]))
    kept = {(r.path, r.obj): r.level for r in pdf_objects.kept(df, roots, gone, ["path"]).collect()}
    assert kept == {("f", 1): 0, ("f", 2): 1, ("f", 3): 2, ("f", 6): 3, ("g", 1): 0, ("h", 1): 0}
    chain = spark.createDataFrame([("c", k, "/N", k + 1) for k in range(1, 20)], "path string, obj int, key string, target int")
    assert pdf_objects.reachable(chain, spark.createDataFrame([("c", 1)], "path string, obj int"), ["path"], 5).count() == 6
