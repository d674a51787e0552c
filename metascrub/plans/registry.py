"""The registered queries of the library and their DuckDB SQL, over tables derived from the driver's documents and pages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascrub.functions import paths, texts
from metascrub.operators import archives, clean, images, packages, pdf_entries, pdf_objects, reports
from metascrub.operators import rewrite as rw
from metascrub.sources import files as fs
from metascrub.sources import fixtures as fx
from metascrub.streaming import dropbox

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the function, and its DuckDB SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def _files(spark, sf) -> DataFrame:
    return fx.table(spark, sf, fx.FILES)


def _results(spark, sf) -> DataFrame:
    return fx.table(spark, sf, fx.RESULTS)


def _ooxml(spark, sf) -> DataFrame:
    return fx.table(spark, sf, fx.parts_sql(fx.PART_NAMES, fx.OOXML_DATA, "spark"))


def _odf(spark, sf) -> DataFrame:
    return fx.table(spark, sf, fx.parts_sql(fx.ODF_NAMES, fx.ODF_DATA, "spark"))


def _pdf(spark, sf) -> DataFrame:
    return fx.table(spark, sf, fx.pdf_sql("spark"))


OOXML = f"({fx.parts_sql(fx.PART_NAMES, fx.OOXML_DATA, 'duckdb')})"
ODF = f"({fx.parts_sql(fx.ODF_NAMES, fx.ODF_DATA, 'duckdb')})"
PDF = f"({fx.pdf_sql('duckdb')})"
D_FILES, D_RESULTS, D_SVG = f"({fx.FILES})", f"({fx.RESULTS})", f"({fx.SVG})"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def cut(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {q(p)}, '', 'g')"
    return x


# --- paths and routing

D_EXT = "case when regexp_matches(base, '^\\.*[^.].*\\.[^.]*$') then '.' || list_last(string_split(base, '.')) else '' end"
D_PATHS = f"(select *, {D_EXT} as ext from (select *, list_last(string_split(path, '/')) as base from {D_FILES}))"
D_FAMILY = "case " + " ".join(f"when lower(ext) in ({', '.join(map(q, g))}) then '{k}'" for k, g in paths.FORMATS.items()) + " end"


@query("proj_path_parts", f"select doc_id, base, ext, left(base, length(base) - length(ext)) as stem, lower(ext) as low from {D_PATHS}")
def proj_path_parts(spark, sf):
    p = F.col("path")
    return _files(spark, sf).select("doc_id", paths.base(p).alias("base"), paths.ext(p).alias("ext"), paths.stem(p).alias("stem"), F.lower(paths.ext(p)).alias("low"))


@query("route_family", f"select doc_id, path, {D_FAMILY} as family, case when {D_FAMILY} is null then 'unsupported file type: ' || (case when ext = '' then '(none)' else lower(ext) end) end as error from {D_PATHS}")
def route_family(spark, sf):
    p = F.col("path")
    return _files(spark, sf).select("doc_id", "path", paths.family(p).alias("family"), paths.unsupported(p).alias("error"))


@query("src_supported", f"""select path, case when {D_FAMILY} is null then 'skipped' end as status, case when {D_FAMILY} is null then 'unsupported file type: ' || (case when ext = '' then '(none)' else lower(ext) end) end as error
  from (select distinct path, ext from {D_PATHS} where doc_id % 3 = 0 or {D_FAMILY} is not null)""")
def src_supported(spark, sf):
    f = _files(spark, sf)
    return fs.supported(f, f.filter("doc_id % 3 = 0"))


@query("src_missing", f"select distinct path from {D_FILES} where path not in (select path from {D_FILES} where doc_id % 4 <> 1)")
def src_missing(spark, sf):
    f = _files(spark, sf)
    return fs.missing(f, f.filter("doc_id % 4 <> 1"))


@query("src_size_limit", f"select doc_id, path, case when length > 2000000 then 'error' end as status, case when length > 2000000 then 'file too large: ' || base end as error from {D_PATHS}")
def src_size_limit(spark, sf):
    return fs.size_limit(_files(spark, sf), 2_000_000).select("doc_id", "path", "status", "error")


@query("src_discover", "select doc_id, octet_length(encode(text))::bigint as length from documents")
def src_discover(spark, sf):
    """Every document as a file of its own is too many files; a folder of files of many documents, listed with their bytes. A file is one row
    when it is read, so its size is bounded: up to 128 documents of 64 KiB at most, or one that is longer."""
    folder = f"{_scratch(spark)}/files"
    line = F.to_json(F.struct("doc_id", F.base64(F.encode("text", "UTF-8")).alias("body"))).alias("value")
    long = F.coalesce(F.octet_length("text") > LONG_TEXT, F.lit(False))
    for rows, each in ((~long, 128), (long, 1)):
        _docs(spark, sf).filter(rows).select(line).write.mode("append").option("maxRecordsPerFile", each).text(folder)
    content = fs.discover(spark, folder, content=True).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> ''")
    told = content.select(F.from_json("line", "doc_id long, body string").alias("x"))
    return told.select("x.doc_id", F.octet_length(F.unbase64("x.body")).cast("long").alias("length"))


LONG_TEXT = 64 << 10  #: bytes of a text that is a file of its own


def _scratch(spark: SparkSession) -> str:
    """A new folder where all executors see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        import uuid

        return f"{at.rstrip('/')}/library-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-") + "/out"


# --- markup

def _step(key: str, table, column: str, pattern: str, digest: bool):
    """Counts and removes one pattern."""

    def run(spark, sf):
        text = F.col(column)
        clean = rw.drop(text, pattern)
        return table(spark, sf).select(key, rw.count(text, pattern).alias("n"), (F.md5(clean) if digest else clean).alias("clean"))

    return run


def _svgs(spark, sf) -> DataFrame:
    return fx.table(spark, sf, fx.SVG)


M = rw.MARKUP
for _k in ("comments", "scripts"):
    query(f"markup_{_k}", f"select page_id, {n_of('html', M[_k])} as n, md5({cut('html', M[_k])}) as clean from pages")(_step("page_id", _pages, "html", M[_k], True))
for _k in ("metadata", "editor"):
    query(f"markup_{_k}", f"select doc_id, {n_of('svg', M[_k])} as n, {cut('svg', M[_k])} as clean from {D_SVG}")(_step("doc_id", _svgs, "svg", M[_k], False))


@query("markup_embedded", f"select doc_id, {n_of('svg', rw.EMBEDDED)} as n from {D_SVG}")
def markup_embedded(spark, sf):
    return _svgs(spark, sf).select("doc_id", rw.count(F.col("svg"), rw.EMBEDDED).alias("n"))


@query("markup_pi", f"""select doc_id, case when {n_of('svg', rw.PI)} > 1 then {n_of('svg', rw.PI)} - 1 else 0 end as n_pi, case when {n_of('svg', rw.PI)} > 1 then left(svg, 21) || {cut('substr(svg, 22)', rw.PI)} else svg end as svg from {D_SVG}""")
def markup_pi(spark, sf):
    return rw.drop_instructions(fx.table(spark, sf, fx.SVG), "svg")


def _scrub_sql(table: str, key: str, column: str) -> str:
    steps = f"select {key}, {column} as t0 from {table}"
    for i, k in enumerate(("metadata", "comments", "scripts", "editor")):
        steps = f"select *, {n_of(f't{i}', M[k])} as n_{k}, {cut(f't{i}', M[k])} as t{i + 1} from ({steps})"
    pi = f"""select *, {n_of('t4', rw.PI)} as k, starts_with(regexp_extract(t4, {q(rw.PI)}), '<?xml') as lead, instr(t4, regexp_extract(t4, {q(rw.PI)})) + length(regexp_extract(t4, {q(rw.PI)})) - 1 as e from ({steps})"""
    out = f"""select *, case when k > 1 then k - lead::int else 0 end as n_pi, case when k > 1 then left(t4, case when lead then e else 0 end) || {cut('substr(t4, (case when lead then e else 0 end) + 1)', rw.PI)} else t4 end as t5 from ({pi})"""
    out = f"select *, {n_of('t5', rw.EMBEDDED)} as n_embedded from ({out})"
    told = """list_filter([case when n_metadata > 0 then 'metadata block' end, case when n_comments > 0 then n_comments || ' comment(s)' end, case when n_scripts > 0 then 'script block(s)' end,
      case when n_editor > 0 then n_editor || ' editor metadata block(s)' end, case when n_pi > 0 then n_pi || ' processing instruction(s)' end,
      case when n_embedded > 0 then n_embedded || ' embedded image(s) present (metadata not scrubbed)' end], lambda x: x is not null)"""
    return f"select {key}, md5(t5) as clean, array_to_string({told}, ', ') as removed, case when len({told}) > 0 then 'ok' else 'clean' end as status from ({out})"


def _scrubbed(df: DataFrame, key: str, column: str) -> DataFrame:
    return rw.scrub_markup(df.select(key, column), column).select(key, F.md5(column).alias("clean"), F.array_join("removed", ", ").alias("removed"), "status")


@query("markup_scrub", _scrub_sql("pages", "page_id", "html"))
def markup_scrub(spark, sf):
    return _scrubbed(_pages(spark, sf), "page_id", "html")


@query("markup_scrub_svg", _scrub_sql(D_SVG, "doc_id", "svg"))
def markup_scrub_svg(spark, sf):
    return _scrubbed(fx.table(spark, sf, fx.SVG), "doc_id", "svg")


# --- packages

def _rules_sql(rules, table):
    case = lambda pick, rest: "case " + " ".join(f"when {r.test} then '{pick(r)}'" for r in rules) + f" else {rest} end"
    return f"select doc_id, part_seq, part_name, {case(lambda r: r.action, q('keep'))} as action, {case(lambda r: r.category, 'null')} as category from (select *, lower(part_name) as low from {table})"


@query("ooxml_rules", _rules_sql(packages.OOXML, OOXML))
def ooxml_rules(spark, sf):
    return packages.dispatch(_ooxml(spark, sf), packages.OOXML).drop("data")


@query("odf_rules", _rules_sql(packages.ODF, ODF))
def odf_rules(spark, sf):
    return packages.dispatch(_odf(spark, sf), packages.ODF).drop("data")


@query("pred_macro_part", f"select doc_id, part_seq, ({packages.MACROS['ooxml']}) as macro from (select *, lower(part_name) as low from {OOXML})")
def pred_macro_part(spark, sf):
    return _ooxml(spark, sf).withColumn("low", F.lower("part_name")).select("doc_id", "part_seq", F.expr(packages.MACROS["ooxml"]).alias("macro"))


@query("pred_media_part", f"select doc_id, part_seq, ({packages.MEDIA}) as media from (select *, lower(part_name) as low from {OOXML})")
def pred_media_part(spark, sf):
    return _ooxml(spark, sf).withColumn("low", F.lower("part_name")).select("doc_id", "part_seq", F.expr(packages.MEDIA).alias("media"))


@query("parts_kept", f"select doc_id, part_seq, part_name from ({_rules_sql(packages.OOXML, OOXML)}) where action <> 'drop' and right(part_name, 1) <> '/'")
def parts_kept(spark, sf):
    return packages.kept(packages.dispatch(_ooxml(spark, sf), packages.OOXML)).select("doc_id", "part_seq", "part_name")


T = packages.TEMPLATES


@query("ooxml_templates", f"select doc_id, part_seq, case lower(part_name) " + " ".join(f"when '{k}' then md5({q(v)})" for k, v in T.items()) + f" else md5(data) end as digest from {OOXML}")
def ooxml_templates(spark, sf):
    return _ooxml(spark, sf).select("doc_id", "part_seq", F.md5(packages.templated(F.col("part_name"), F.col("data"))).alias("digest"))


def _fields_sql(pattern: str, seq: int) -> str:
    return f"""select doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_zip(regexp_extract_all(data, {q(pattern)}, 1), regexp_extract_all(data, {q(pattern)}, 2)), lambda x: trim(x[2]) <> ''), lambda x: x[1]))), ',') as fields from {OOXML} where part_seq = {seq}"""


@query("ooxml_core_fields", _fields_sql(rw.CORE_FIELD, 0))
def ooxml_core_fields(spark, sf):
    return _ooxml(spark, sf).filter("part_seq = 0").select("doc_id", F.array_join(rw.fields(F.col("data"), rw.CORE_FIELD), ",").alias("fields"))


@query("ooxml_app_fields", _fields_sql(rw.APP_FIELD, 1))
def ooxml_app_fields(spark, sf):
    return _ooxml(spark, sf).filter("part_seq = 1").select("doc_id", F.array_join(rw.fields(F.col("data"), rw.APP_FIELD), ",").alias("fields"))


def _part(name: str, seq: int, *patterns: str) -> None:
    """Registers the count and removal of patterns in the part of one number; all are counted on the original."""

    def run(spark, sf):
        data = F.col("data")
        total, out = F.lit(0), data
        for p in patterns:
            total, out = total + rw.count(data, p), rw.drop(out, p)
        return _ooxml(spark, sf).filter(F.col("part_seq") == seq).select("doc_id", total.cast("long").alias("n"), out.alias("clean"))

    query(name, f"select doc_id, ({' + '.join(n_of('data', p) for p in patterns)})::bigint as n, {cut('data', *patterns)} as clean from {OOXML} where part_seq = {seq}")(run)


_part("ooxml_rsid", 18, rw.RSID, rw.RSIDS)
_part("ooxml_track_changes", 18, rw.AUTHOR, rw.DATE)
_part("ooxml_comment_ranges", 18, rw.COMMENT_RANGE)
_part("ooxml_vba_refs", 20, rw.VBA_REF)
_part("ooxml_customxml_refs", 19, rw.CUSTOMXML_REF)
_part("ooxml_rels_refs", 20, rw.RELS_REF)
_part("ooxml_ct_refs", 19, rw.TYPES_REF)

_REWRITE = f"select *, lower(part_name) as low, data as new_data from {OOXML}"
_XML = "right(low, 4) = '.xml'"
_REWRITE = f"select * replace (case when {_XML} then {cut('new_data', rw.RSID, rw.RSIDS, rw.AUTHOR, rw.DATE, rw.COMMENT_RANGE)} else new_data end as new_data), case when {_XML} then {n_of('data', rw.RSID)} + {n_of('data', rw.RSIDS)} else 0 end as n_rsid, case when {_XML} then {n_of('data', rw.AUTHOR)} + {n_of('data', rw.DATE)} else 0 end as n_track_changes, case when {_XML} then {n_of('data', rw.COMMENT_RANGE)} else 0 end as n_comment_ranges from ({_REWRITE})"
for _where, _patterns in (("low = '[content_types].xml' or right(low, 5) = '.rels'", (rw.VBA_REF, rw.CUSTOMXML_REF)), ("right(low, 5) = '.rels'", (rw.RELS_REF,)), ("low = '[content_types].xml'", (rw.TYPES_REF,))):
    _REWRITE = f"select * replace (case when {_where} then {cut('new_data', *_patterns)} else new_data end as new_data) from ({_REWRITE})"


@query("ooxml_rewrite", f"select doc_id, part_seq, n_rsid::int as n_rsid, n_track_changes::int as n_track_changes, n_comment_ranges::int as n_comment_ranges, md5(new_data) as digest from ({_REWRITE})")
def ooxml_rewrite(spark, sf):
    return packages.rewrite_ooxml(_ooxml(spark, sf)).select("doc_id", "part_seq", "n_rsid", "n_track_changes", "n_comment_ranges", F.md5("new_data").alias("digest"))


@query("odf_meta", f"select doc_id, array_to_string(list_sort(list_filter([{', '.join(f'case when regexp_matches(data, {q(p)}) then {q(k)} end' for k, p in rw.ODF_FIELDS.items())}], lambda x: x is not null)), ',') as fields, md5({q(T['meta.xml'])}) as digest from {ODF} where part_seq = 1")
def odf_meta(spark, sf):
    return _odf(spark, sf).filter("part_seq = 1").select("doc_id", F.array_join(rw.odf_fields(F.col("data")), ",").alias("fields"), F.md5(packages.templated(F.col("part_name"), F.col("data"))).alias("digest"))


def _odf_steps(patterns: list[str]) -> str:
    sql = f"select doc_id, data as t0 from {ODF} where part_seq = 2"
    for i, p in enumerate(patterns):
        sql = f"select *, {n_of(f't{i}', p)} as k{i}, {cut(f't{i}', p)} as t{i + 1} from ({sql})"
    return sql


@query("odf_changes", f"select doc_id, ({' + '.join(f'k{i}' for i in range(6))})::int as n_changes, t6 as clean from ({_odf_steps(rw.ODF_CHANGES)})")
def odf_changes(spark, sf):
    return rw.strip(_odf(spark, sf).filter("part_seq = 2").select("doc_id", F.col("data").alias("clean")), "clean", {"changes": rw.ODF_CHANGES})


@query("odf_annotations", f"select doc_id, k0::int as n_annotations, t1 as clean from ({_odf_steps([rw.ODF_ANNOTATION])})")
def odf_annotations(spark, sf):
    return rw.strip(_odf(spark, sf).filter("part_seq = 2").select("doc_id", F.col("data").alias("clean")), "clean", {"annotations": [rw.ODF_ANNOTATION]})


@query("odf_settings", f"select doc_id, {n_of('data', rw.ODF_SETTINGS)}::int as n_settings, {cut('data', rw.ODF_SETTINGS)} as clean from {ODF} where part_seq = 3")
def odf_settings(spark, sf):
    return rw.strip(_odf(spark, sf).filter("part_seq = 3").select("doc_id", F.col("data").alias("clean")), "clean", {"settings": [rw.ODF_SETTINGS]})


D_NAMES = f"(select doc_id, case doc_id % 12 when 0 then '' when 1 then '/etc/x' when 2 then '\\x' when 3 then 'c:/x' when 4 then 'a/../b' when 5 then '..\\b' when 6 then repeat('n', 600) when 7 then 'a' || chr(0) when 8 then 'word/document.xml' when 9 then 'a..b/c' when 10 then 'd/e' else 'f' end as name from documents)"


@query("check_zip_names", f"""select doc_id, case when name = '' or length(name) > 512 then 'bad length' when name[1] in ('/', '\\') then 'absolute path' when regexp_matches(name, '^[A-Za-z]:') then 'drive letter'
  when contains(name, chr(0)) then 'NUL' when list_contains(string_split(replace(name, '\\', '/'), '/'), '..') then 'parent folder' end as unsafe from {D_NAMES}""")
def check_zip_names(spark, sf):
    df = _docs(spark, sf)
    names = ["", "/etc/x", "\\x", "c:/x", "a/../b", "..\\b", "n" * 600, "a\0", "word/document.xml", "a..b/c", "d/e", "f"]
    name = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 12).cast("int"))
    return df.select("doc_id", packages.unsafe_name(name).alias("unsafe"))


@query("check_zip_limits", f"select doc_id, count(*) as n_entries, max(length(data))::bigint as largest, sum(length(data))::bigint as total, case when count(*) > 20 then 'too many entries' end as verdict from {OOXML} group by doc_id")
def check_zip_limits(spark, sf):
    parts = _ooxml(spark, sf).withColumn("size", F.char_length("data").cast("long"))
    return packages.limits(parts, "doc_id", "size", entries=20)


@query("zip_duplicate_names", f"select doc_id, part_seq, part_name, last_value(data) over (partition by doc_id, part_name order by part_seq rows between unbounded preceding and unbounded following) as data from (select doc_id, part_seq, data, 'n' || part_seq % 3 as part_name from {OOXML})")
def zip_duplicate_names(spark, sf):
    return packages.last_copy(_ooxml(spark, sf).withColumn("part_name", F.concat(F.lit("n"), F.col("part_seq") % 3)), "doc_id").select("doc_id", "part_seq", "part_name", "data")


@query("rules_first_match", f"select doc_id, part_seq, part_name, case when starts_with(lower(part_name), 'word/vba') then 'drop' when starts_with(lower(part_name), 'word/') then 'rewrite' else 'keep' end as action from {OOXML}")
def rules_first_match(spark, sf):
    rules = spark.createDataFrame([("word/", 2, "rewrite"), ("word/vba", 1, "drop"), ("word/media/", 3, "strip")], "prefix string, priority int, action string")
    return packages.first_match(_ooxml(spark, sf).drop("data"), rules)


@query("sink_zip_normalized", f"select doc_id, count(*) filter (where right(part_name, 1) <> '/') as n_parts, md5(string_agg(part_name || data, '' order by part_seq) filter (where right(part_name, 1) <> '/')) as digest from {OOXML} group by doc_id")
def sink_zip_normalized(spark, sf):
    packed = archives.pack_zip(_ooxml(spark, sf).withColumn("data", F.encode("data", "UTF-8")), "doc_id")
    parts = archives.unzip_parts(packed, "doc_id").withColumn("t", F.concat("part_name", F.decode("data", "UTF-8")))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_seq", "t"))), lambda x: x["t"]), "")
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.md5(told).alias("digest"))


# --- whole packages and SVG files

def _parts_digest(done: DataFrame) -> DataFrame:
    """doc_id, status, removed and a digest over the parts of the cleaned archives, in one pass."""
    return archives.digests(done.select("doc_id", "status", F.array_join("removed", "; ").alias("removed"), F.col("new_content").alias("content")))


OFFICE, OPEN = fx.parts_array(fx.PART_NAMES, fx.OOXML_DATA), fx.parts_array(fx.ODF_NAMES, fx.ODF_DATA)


def _packed(spark, sf, parts: str) -> DataFrame:
    """(doc_id, content): an archive of each document, composed where the document is."""
    return archives.pack_lists(fx.table(spark, sf, f"select doc_id, {parts} as parts from documents", dealt=True), "doc_id")


def _clean_sql(rules, table: str, rewritten: str, removed: str) -> str:
    template = "case lower(part_name) " + " ".join(f"when '{k}' then {q(v)}" for k, v in T.items()) + " end"
    return f"""select doc_id, count(*) as n_parts, md5(string_agg(part_name || (case action when 'template' then {template} when 'rewrite' then new_data else data end), '' order by part_seq)) as digest, 'ok' as status, any_value({removed}) as removed
      from ({_rules_sql(rules, table)}) join ({rewritten}) using (doc_id, part_seq, part_name) where action <> 'drop' and right(part_name, 1) <> '/' group by doc_id"""


_OFFICE_TOLD = """'document properties (created, creator, lastModifiedBy); app properties (Application, ' || (case when doc_id % 2 = 0 then 'Company, ' else '' end) || 'TotalTime); custom properties; document comments; comment author list; extended comment metadata; comment-to-paragraph mapping; 2 VBA macro parts removed; '
  || (case when doc_id % 2 = 0 then 4 else 3 end) || ' edit-session ID(s) removed (rsid); 1 custom XML metadata part(s) removed; 1 thumbnail(s) removed (unsanitized format); 2 track-change author attribution(s) removed; 3 comment reference(s) removed from document; 1 digital signature part(s) removed; 1 PPTX comment(s) removed; 1 PPTX speaker note(s) removed; 1 XLSX external link(s) removed; 1 XLSX sheet comment(s) removed'"""


@query("clean_office", _clean_sql(packages.OOXML, OOXML, f"select doc_id, part_seq, part_name, data, new_data from ({_REWRITE})", _OFFICE_TOLD))
def clean_office(spark, sf):
    return _parts_digest(clean.clean_packages(_packed(spark, sf, OFFICE), "office", key="doc_id"))


_ODF_NEW = "data"
for _p in [*rw.ODF_CHANGES, rw.ODF_ANNOTATION]:
    _ODF_NEW = cut(_ODF_NEW, _p)
_ODF_NEW = f"select doc_id, part_seq, part_name, data, case part_seq when 2 then {_ODF_NEW} when 3 then {cut('data', rw.ODF_SETTINGS)} else data end as new_data from {ODF}"
_ODF_TOLD = """'document metadata (creator, ' || (case when doc_id % 2 = 0 then 'document-statistic, ' else '' end) || 'initial-creator' || (case when doc_id % 2 = 0 then ', title' else '' end) || '); 2 macro part(s) removed; 6 track-change field(s) removed; '
  || (case when doc_id % 3 = 0 then '1 annotation(s) removed; ' else '' end) || '2 settings author field(s) removed; 1 custom UI part(s) removed'"""


@query("clean_odf", _clean_sql(packages.ODF, ODF, _ODF_NEW, _ODF_TOLD))
def clean_odf(spark, sf):
    return _parts_digest(clean.clean_packages(_packed(spark, sf, OPEN), "odf", key="doc_id"))


@query("clean_svg", _scrub_sql(D_SVG, "doc_id", "svg"))
def clean_svg(spark, sf):
    files = _svgs(spark, sf).select("doc_id", F.encode("svg", "UTF-8").alias("content"))
    return clean.clean_svg(files, "doc_id").select("doc_id", F.md5("new_content").alias("clean"), F.array_join("removed", ", ").alias("removed"), "status")


# --- images: fixtures are composed of the same pieces in both engines

SEGMENT = 60_000  #: bytes of a text in one segment


def _jpeg(text: F.Column, removed: bool) -> F.Column:
    p = F.encode(text, "UTF-8")
    seg = lambda mark, body: F.concat(F.unhex(F.lit(mark)), F.unhex(F.lpad(F.hex(F.octet_length(body) + 2), 4, "0")), body)
    pieces = [F.unhex(F.lit("FFD8FFE000074A46494600"))]
    if removed:
        # the whole text, in as many segments as it needs; an empty one in one
        many = lambda mark, lead: F.aggregate(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(p) / SEGMENT) - 1, F.lit(0))), F.unhex(F.lit("")), lambda a, i: F.concat(a, seg(mark, F.concat(F.unhex(F.lit(lead)), F.substring(p, (i * SEGMENT + 1).cast("int"), F.lit(SEGMENT))))))
        pieces += [many("FFE1", "457869660000"), many("FFFE", ""), many("FFED", "")]
    pieces += [F.unhex(F.lit("FFC0000B080001000101011100")), F.unhex(F.lit("FFDA0008010100003F00")), F.encode(F.lit("scan"), "UTF-8"), F.unhex(F.lit("FFD9"))]
    return F.concat(*pieces)


#: What is left of a JPEG, composed by DuckDB.
D_JPEG = " || ".join(["unhex('FFD8FFE000074A46494600')", "unhex('FFC0000B080001000101011100')", "unhex('FFDA0008010100003F00')", "encode('scan')", "unhex('FFD9')"])


def _png(text: F.Column, removed: bool) -> F.Column:
    p = F.encode(text, "UTF-8")
    word = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    chunk = lambda kind, body: F.concat(word(F.octet_length(body)), F.encode(F.lit(kind), "UTF-8"), body, word(F.crc32(F.concat(F.encode(F.lit(kind), "UTF-8"), body))))
    pieces = [F.unhex(F.lit("89504E470D0A1A0A")), chunk("IHDR", F.unhex(F.lit("00000001000000010802000000")))]
    if removed:
        pieces += [chunk("tEXt", p), chunk("tIME", F.unhex(F.lit("07E40101000000"))), chunk("prVt", p)]
    return F.concat(*pieces, chunk("gAMA", F.unhex(F.lit("0000B18F"))), chunk("IDAT", p), chunk("IEND", F.unhex(F.lit(""))))


def _webp(text: F.Column, removed: bool) -> F.Column:
    p = F.encode(text, "UTF-8")
    little = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]))
    chunk = lambda kind, body: F.concat(F.encode(F.lit(kind), "UTF-8"), little(F.octet_length(body)), body, F.when(F.octet_length(body) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    body = F.concat(chunk("VP8X", F.unhex(F.lit("18000000000000000000" if removed else "00000000000000000000"))), chunk("VP8 ", p), *([chunk("EXIF", p), chunk("XMP ", p)] if removed else []))
    return F.concat(F.encode(F.lit("RIFF"), "UTF-8"), little(F.octet_length(body) + 4), F.encode(F.lit("WEBP"), "UTF-8"), body)


def _image(make, status_clean: bool = False):
    """Strips generated files and shows what the strip gives; for jpeg DuckDB composes the expected bytes."""

    def run(spark, sf):
        text = F.col("text")
        made = _docs(spark, sf).select(F.struct("doc_id", F.md5(make(text, False)).alias("expected")).alias("doc"), make(text, True).alias("content"))
        return clean.strip_images(made, key="doc").select("doc.doc_id", F.md5("new_content").alias("digest"), F.array_join("removed", ", ").alias("removed"), "status", (F.md5("new_content") == F.col("doc.expected")).alias("as_expected"))

    return run


query("jpeg_strip", f"select doc_id, md5({D_JPEG}) as digest, 'EXIF metadata, embedded comment, Photoshop metadata (layers/paths/IPTC)' as removed, 'ok' as status, true as as_expected from documents")(_image(_jpeg))
_LITTLE = lambda n: "unhex(printf('%02X%02X%02X%02X', " + ", ".join(f"(({n}) >> {8 * k}) & 255" for k in range(4)) + "))"
_P = "encode(text)"
_PAD = f"(case when octet_length({_P}) % 2 = 1 then unhex('00') else unhex('') end)"
D_WEBP = f"encode('RIFF') || {_LITTLE(f'4 + 18 + 8 + octet_length({_P}) + octet_length({_P}) % 2')} || encode('WEBPVP8X') || {_LITTLE('10')} || unhex('00000000000000000000') || encode('VP8 ') || {_LITTLE(f'octet_length({_P})')} || {_P} || {_PAD}"
query("webp_strip", f"select doc_id, md5({D_WEBP}) as digest, 'EXIF metadata, XMP metadata' as removed, 'ok' as status, true as as_expected from documents")(_image(_webp))


@query("png_strip", f"select doc_id, 8 + 25 + 16 + 12 + octet_length({_P}) + 12 as n_bytes, '1 text chunk(s), modification timestamp, 1 unknown chunk(s)' as removed, 'ok' as status, true as as_expected from documents")
def png_strip(spark, sf):
    """DuckDB has no checksum of chunks: the bytes are compared with those that Spark composes."""
    text = F.col("text")
    made = _docs(spark, sf).select(F.struct("doc_id", F.md5(_png(text, False)).alias("expected")).alias("doc"), _png(text, True).alias("content"))
    return clean.strip_images(made, key="doc").select("doc.doc_id", F.octet_length("new_content").cast("long").alias("n_bytes"), F.array_join("removed", ", ").alias("removed"), "status", (F.md5("new_content") == F.col("doc.expected")).alias("as_expected"))


@query("status_clean_identical", f"select doc_id, md5({D_JPEG}) as digest, 'clean' as status from documents")
def status_clean_identical(spark, sf):
    made = _docs(spark, sf).select("doc_id", _jpeg(F.col("text"), False).alias("content"))
    return clean.strip_images(made).select("doc_id", F.md5("new_content").alias("digest"), "status")


@query("check_structure", f"select doc_id, case when doc_id % 2 = 0 then 'ok' else 'error' end as status, case when doc_id % 2 = 1 then 'corrupt image' end as error from documents")
def check_structure(spark, sf):
    whole = _jpeg(F.col("text"), True)
    made = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, whole).otherwise(F.substring(whole, 1, 40)).alias("content"))
    return clean.strip_images(made).select("doc_id", "status", "error")


@query("bad_file_isolated", "select doc_id, case doc_id % 3 when 0 then 'ok' else 'error' end as status, case doc_id % 3 when 1 then 'not a valid image' when 2 then 'not a valid image' end as error from documents")
def bad_file_isolated(spark, sf):
    content = F.when(F.col("doc_id") % 3 == 0, _jpeg(F.col("text"), True)).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-8"))
    return clean.strip_images(_docs(spark, sf).select("doc_id", content.alias("content"))).select("doc_id", "status", "error")


_EACH = "generate_series(1, ceil(octet_length(encode(text)) / 60000.0)::bigint)"


@query("parts_explode", f"""select doc_id, unnest(range(len(kinds)))::int as part_seq, unnest(kinds) as part_kind from (
  select doc_id, ['D8', 'E0'] || list_transform({_EACH}, lambda i: 'E1') || list_transform({_EACH}, lambda i: 'FE') || list_transform({_EACH}, lambda i: 'ED') || ['C0', 'scan'] as kinds from documents)""")
def parts_explode(spark, sf):
    """An empty text stands in no segment."""
    text = F.col("text")
    made = _docs(spark, sf).select("doc_id", F.when(text == "", _jpeg(text, False)).otherwise(_jpeg(text, True)).alias("content"))
    return images.explode_parts(made).select("doc_id", "part_seq", "part_kind")


@query("check_signature", "select doc_id, doc_id % 5 = 0 as jpeg, doc_id % 5 = 1 as png, doc_id % 5 = 2 as webp, doc_id % 5 = 3 and contains(lower(left('<?xml?><' || lang || '><SVG>' || text, 1024)), '<svg') as svg from documents")
def check_signature(spark, sf):
    text, kind = F.col("text"), F.col("doc_id") % 5
    made = F.when(kind == 0, _jpeg(text, True)).when(kind == 1, _png(text, True)).when(kind == 2, _webp(text, True)).when(kind == 3, F.encode(F.concat(F.lit("<?xml?><"), "lang", F.lit("><SVG>"), text), "UTF-8")).otherwise(F.encode(text, "UTF-8"))
    made = _docs(spark, sf).select("doc_id", made.alias("content"))
    return made.select("doc_id", *[F.coalesce(images.signature(F.col("content"), k), F.lit(False)).alias(k) for k in ("jpeg", "png", "webp", "svg")])


def _exif(spark, sf) -> DataFrame:
    return _docs(spark, sf).select("doc_id", _tiff(F.col("doc_id")).alias("content"))


def _tiff(d: F.Column) -> F.Column:
    """Big-endian TIFF structures: maker, GPS directory with latitude and longitude from d."""
    n = lambda c: F.lpad(F.hex(c), 8, "0")
    one = lambda c: F.concat(n(c.cast("long")), F.lit("00000001"))
    head = F.lit("4D4D002A00000008" + "0002" + "010F000200000002" + "41000000" + "8825000400000001" + "00000026" + "00000000")
    where = F.lit("0004" + "0001000200000002" + "53000000" + "0002000500000003" + "0000005C" + "0003000200000002" + "45000000" + "0004000500000003" + "00000074" + "00000000")
    pad = F.lit("")
    lat = F.concat(one(d % 90), one(d % 60), n(d % 120), F.lit("00000002"))
    lon = F.concat(one(d % 180), one(d % 59), n(d % 118), F.lit("00000002"))
    return F.unhex(F.concat(head, where, pad, lat, lon))


@query("gps_parse", "select doc_id, (doc_id % 90)::double as lat_d, (doc_id % 60)::double as lat_m, (doc_id % 120) / 2.0 as lat_s, 'S' as lat_ref, (doc_id % 180)::double as lon_d, (doc_id % 59)::double as lon_m, (doc_id % 118) / 2.0 as lon_s, 'E' as lon_ref from documents")
def gps_parse(spark, sf):
    g = images.gps_of(_exif(spark, sf))
    at = lambda c, k: F.get(c, F.lit(k))
    return g.select("doc_id", at("lat", 0).alias("lat_d"), at("lat", 1).alias("lat_m"), at("lat", 2).alias("lat_s"), "lat_ref", at("lon", 0).alias("lon_d"), at("lon", 1).alias("lon_m"), at("lon", 2).alias("lon_s"), "lon_ref")


@query("gps_format", "select doc_id, (doc_id % 90) || '°' || (doc_id % 60) || '''' || printf('%.0f', (doc_id % 120) / 2.0) || '\"S, ' || (doc_id % 180) || '°' || (doc_id % 59) || '''' || printf('%.0f', (doc_id % 118) / 2.0) || '\"E' as gps from documents")
def gps_format(spark, sf):
    g = images.gps_of(_exif(spark, sf))
    return g.select("doc_id", texts.gps_text(F.col("lat"), F.col("lat_ref"), F.col("lon"), F.col("lon_ref")).alias("gps"))


_TIFF_TEXT = "octet_length(encode(text)) + 1"


@query("tiff_identity_audit", f"""select doc_id, directory, tag, n_values, digest from (
    select doc_id, '0' as directory, 271 as tag, 2 as n_values, md5(unhex('4100')) as digest from documents where doc_id % 3 = 0
    union all select doc_id, '1', 315, {_TIFF_TEXT}, md5(encode(text) || unhex('00')) from documents where doc_id % 3 <> 2)""")
def tiff_identity_audit(spark, sf):
    """TIFF files of two pages whose chain leads back to the first one: the whole text is the artist of the second page. Values of up to
    four bytes stand in the entry. The artist of a null text is told without its value."""
    n = lambda c: F.lpad(F.hex(c), 8, "0")
    d, body = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    first = F.when(d % 3 == 0, F.lit("010F00020000000241000000")).otherwise(F.lit("010000030000000100010000"))  # maker, or a width
    where = F.when(F.octet_length(body) < 4, F.rpad(F.hex(body), 8, "0")).otherwise(F.lit("0000002C"))
    second = F.when(d % 3 == 2, F.lit("010000030000000100010000")).otherwise(F.concat(F.lit("013B0002"), n(F.octet_length(body) + 1), where))
    pages = F.concat(F.lit("4D4D002A00000008" + "0001"), first, F.lit("0000001A" + "0001"), second, F.lit("00000008"))
    made = _docs(spark, sf).select("doc_id", F.col("text").isNull().alias("unknown"), F.concat(F.unhex(pages), body, F.unhex(F.lit("00"))).alias("content"))
    told = lambda c: F.when(~(F.col("unknown") & (F.col("tag") == 315)), c)
    return images.identity(images.directory_rows(made)).select("doc_id", "directory", "tag", told(F.col("n_values")).alias("n_values"), told(F.md5("value")).alias("digest"))


@query("ooxml_media", f"select doc_id, md5({D_JPEG}) as digest, 1 as n from documents")
def ooxml_media(spark, sf):
    parts = _docs(spark, sf).select("doc_id", F.lit("word/media/b.jpg").alias("part_name"), _jpeg(F.col("text"), True).alias("content"))
    return clean.strip_images(packages.dispatch(parts, packages.OOXML).filter("action = 'strip'")).select("doc_id", F.md5("new_content").alias("digest"), (F.size("removed") > 0).cast("int").alias("n"))


# --- PDF entries

def _pdf_query(name: str, category: str, where: str) -> None:
    query(name, f"select doc_id, node from {PDF} where {where}")(lambda spark, sf: pdf_entries.removals(_pdf(spark, sf), ["doc_id"]).filter(F.col("category") == category).select("doc_id", "node"))


_RUNS = f"(node in (select parent from {PDF} r where r.doc_id = e.doc_id and r.key = '/S' and r.value in ('/JavaScript', '/Launch')))"
_pdf_query("pdf_attachments", "attachments", "parent = 'Root/Names' and key = '/EmbeddedFiles'")
_pdf_query("pdf_metadata", "metadata", "key in ('/Metadata', '/PieceInfo')")
_pdf_query("pdf_form_values", "form values", "parent = 'Root/AcroForm/Fields/0' and key in ('/V', '/DV', '/TU', '/TM')")
_pdf_query("pdf_annotations", "annotations", "parent = 'Root/Pages/0/Annots/0' and key in ('/Author', '/T', '/RC', '/NM', '/CreationDate', '/M', '/Subj')")
_ACTION_SQL = f"select distinct e.doc_id, e.node from {PDF} e join {PDF} r on r.doc_id = e.doc_id and r.parent = e.node and r.key = '/S' and r.value in ('/JavaScript', '/Launch') where regexp_matches(e.node, {q(pdf_entries.ACTIONS)})"
_SCRIPTS_SQL = f"select doc_id, node from {PDF} where key in ('/JS', '/JavaScript') or (parent = 'Root/AcroForm' and key = '/XFA') union select doc_id, node from ({_ACTION_SQL})"
query("pdf_scripts", _SCRIPTS_SQL)(lambda spark, sf: pdf_entries.removals(_pdf(spark, sf), ["doc_id"]).filter("category = 'scripts'").select("doc_id", "node"))
query("pdf_actions", _ACTION_SQL)(lambda spark, sf: pdf_entries.actions(_pdf(spark, sf), ["doc_id"]).select("doc_id", "node"))


@query("pdf_docinfo", f"select doc_id, 'document info (' || string_agg(key, ', ' order by seq) || ')' as removed from {PDF} where parent = 'Info' group by doc_id")
def pdf_docinfo(spark, sf):
    return pdf_entries.docinfo(_pdf(spark, sf), ["doc_id"])


@query("pdf_outline_id", f"select doc_id, node, case when parent = 'Trailer' then repeat('00', 16) end as new_value from {PDF} where (parent = 'Root/Outlines/First' and key = '/NM') or (parent = 'Trailer' and key = '/ID')")
def pdf_outline_id(spark, sf):
    rows = _pdf(spark, sf)
    gone = pdf_entries.removals(rows, ["doc_id"]).filter("category = 'outline'").select("doc_id", "node", F.lit(None).cast("string").alias("new_value"))
    return gone.unionByName(pdf_entries.zeroed_ids(rows, ["doc_id"]))


_GONE_SQL = f"""select doc_id, node from {PDF} where parent = 'Info' or key in ('/Metadata', '/PieceInfo') or (parent = 'Root/AcroForm/Fields/0' and key in ('/V', '/DV', '/TU', '/TM'))
  or (parent = 'Root/Pages/0/Annots/0' and key in ('/Author', '/T', '/RC', '/NM', '/CreationDate', '/M', '/Subj')) or (parent = 'Root/Outlines/First' and key = '/NM') or (parent = 'Root/Names' and key = '/EmbeddedFiles') union {_SCRIPTS_SQL}"""


@query("pdf_subtree_drop", f"select doc_id, node, value from {PDF} p where not exists (select 1 from ({_GONE_SQL}) g where g.doc_id = p.doc_id and (p.node = g.node or starts_with(p.node, g.node || '/')))")
def pdf_subtree_drop(spark, sf):
    rows = _pdf(spark, sf)
    return pdf_entries.drop_subtrees(rows, pdf_entries.removals(rows, ["doc_id"]), ["doc_id"]).select("doc_id", "node", "value")


#: (object, key, target) of one PDF: a page tree with ways back, an action chain that is a ring, a font and a stream that several hold.
_OBJECTS = [
    (1, "/Pages", 2), (2, "/Kids/0", 3), (2, "/Kids/1", 4), (3, "/Parent", 2), (4, "/Parent", 2), (3, "/A", 5), (5, "/Next", 6), (6, "/Next", 5), (3, "/Font", 7), (5, "/F", 7), (4, "/OpenAction", 8), (8, "/D", 9), (1, "/Metadata", 10),
    (9, "/Metadata", 11), (11, "/Length", 12), (7, "/Length", 12), (6, "/Names", 13), (13, "/JS", 14), (4, "/Annots/0", 15), (15, "/AA/E", 5), (15, "/Popup", 4),
]


def _objects_sql(engine: str) -> str:
    o, k, t = (", ".join(repr(x[i]) for x in _OBJECTS) for i in range(3))
    if engine == "spark":
        src = f"select doc_id, source, i, obj, array({k})[i] as key, array({t})[i] as target from (select *, posexplode(array({o})) as (i, obj) from documents)"
    else:
        src = f"select doc_id, source, unnest(range({len(_OBJECTS)}))::int as i, unnest([{o}]) as obj, unnest([{k}]) as key, unnest([{t}]) as target from documents"
    return f"select doc_id, obj, key, target from ({src}) where (doc_id + i) % 11 <> 0 or length(source) % 2 = 0"


@query("pdf_objects_kept", f"""with recursive e as ({_objects_sql('duckdb')}), good as (
    select * from e where key not in ('/Metadata', '/PieceInfo', '/JS', '/JavaScript') and not ((key in ('/A', '/OpenAction') or starts_with(key, '/AA')) and target = 5)),
  r as (select distinct doc_id, 1 as obj from documents union select g.doc_id, g.target from r join good g on g.doc_id = r.doc_id and g.obj = r.obj)
  select doc_id, obj from r""")
def pdf_objects_kept(spark, sf):
    """Object 5 is a script, object 8 is none."""
    edges = fx.table(spark, sf, _objects_sql("spark"))
    roots = _docs(spark, sf).select("doc_id", F.lit(1).alias("obj"))
    gone = edges.filter(F.col("key").isin(pdf_objects.GONE)).unionByName(pdf_objects.code_actions(edges, _docs(spark, sf).select("doc_id", F.lit(5).alias("obj")), ["doc_id"]))
    return pdf_objects.kept(edges, roots, gone, ["doc_id"]).select("doc_id", "obj")


# --- results, findings, counts

@query("join_results", f"select r.path, r.status, i.details from {D_RESULTS} r join (select path, 'd' || doc_id as details from {D_RESULTS} where doc_id % 3 <> 0) i on r.path = i.path")
def join_results(spark, sf):
    r = _results(spark, sf)
    return reports.match_results(r.select("path", "status"), r.filter("doc_id % 3 <> 0").select("path", F.concat(F.lit("d"), "doc_id").alias("details")))


@query("dedup_paths", f"select distinct path from {D_FILES} where path not in (select path from {D_FILES} where doc_id % 5 = 0)")
def dedup_paths(spark, sf):
    f = _files(spark, sf).select("doc_id", "path")
    return reports.new_paths(f, f.filter("doc_id % 5 = 0"))


@query("join_sizes", f"select a.path, a.src_size, b.out_size from {D_RESULTS} a join (select dst, out_size from {D_RESULTS} where status in ('ok', 'clean')) b on a.dst = b.dst")
def join_sizes(spark, sf):
    r = _results(spark, sf)
    return reports.match_sizes(r.select("path", "dst", "src_size"), r.filter("status in ('ok', 'clean')").select("dst", "out_size"))


_FOUND = f"select doc_id, category, 1 as hits, 'd' || part_seq % 4 as text, part_seq as ord from ({_rules_sql(packages.OOXML, OOXML)}) where category is not null"


def _found(spark, sf) -> DataFrame:
    return packages.dispatch(_ooxml(spark, sf), packages.OOXML).filter("category is not null").select("doc_id", "category", F.lit(1).alias("hits"), F.concat(F.lit("d"), F.col("part_seq") % 4).alias("text"), F.col("part_seq").alias("ord"))


@query("agg_findings", f"select doc_id, category, sum(hits)::bigint as n from ({_FOUND}) group by all")
def agg_findings(spark, sf):
    return reports.findings(_found(spark, sf), "doc_id")


@query("agg_removed_list", f"select doc_id, {_OFFICE_TOLD} as removed from documents")
def agg_removed_list(spark, sf):
    """From the findings in the parts of every archive; clean_office has the same list from the cleaning itself."""
    files = _packed(spark, sf, OFFICE).select(F.concat("doc_id", F.lit(".docx")).alias("path"), "content")
    told = clean.removed_lists(clean.findings(files))
    return told.select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), F.array_join("removed", "; ").alias("removed"))


@query("findings_all", f"select doc_id, category, n from (select doc_id, category, sum(hits)::bigint as n from ({_FOUND}) group by all union all select doc_id, category, count(*) as n from ({_rules_sql(packages.ODF, ODF)}) where category is not null group by all)")
def findings_all(spark, sf):
    odf = packages.dispatch(_odf(spark, sf), packages.ODF).filter("category is not null").withColumn("hits", F.lit(1))
    return reports.findings(_found(spark, sf), "doc_id").unionByName(reports.findings(odf, "doc_id"))


@query("agg_status", f"select d.doc_id, case when coalesce(n, 0) > 0 then 'ok' else 'clean' end as status from documents d left join (select doc_id, count(*) as n from ({_FOUND}) group by all) using (doc_id)")
def agg_status(spark, sf):
    told = reports.removed_list(_found(spark, sf), "doc_id")
    return _docs(spark, sf).select("doc_id").join(told, "doc_id", "left").select("doc_id", reports.status_of(F.coalesce("removed", F.array().cast("array<string>"))).alias("status"))


@query("agg_status_counts", f"select s as status, (select count(*) from {D_RESULTS} where status = s) as n_files from (select unnest(['ok', 'clean', 'skipped', 'error']) as s)")
def agg_status_counts(spark, sf):
    return reports.status_counts(_results(spark, sf), spark)


@query("agg_bytes_saved", f"select coalesce(sum(greatest(src_size - out_size, 0)), 0)::bigint as bytes_saved from {D_RESULTS} where status in ('ok', 'clean')")
def agg_bytes_saved(spark, sf):
    return reports.saved_bytes(_results(spark, sf))


@query("agg_saving_pct", f"select doc_id, src_size - out_size as saved, case when src_size = 0 then 0.0::double else ((src_size - out_size) * 100.0::double) / src_size end as pct from {D_RESULTS}")
def agg_saving_pct(spark, sf):
    return reports.saving(_results(spark, sf)).select("doc_id", "saved", "pct")


def _jpeg_with_gps(text: F.Column, d: F.Column) -> F.Column:
    """A JPEG with the whole text in comments, an Exif segment without a position, and one for d and for d + 1."""
    whole = _jpeg(text, True)
    seg = lambda body: F.concat(F.unhex(F.lit("FFE1")), F.unhex(F.lpad(F.hex(F.octet_length(body) + 8), 4, "0")), F.unhex(F.lit("457869660000")), body)
    bare = F.unhex(F.lit("4D4D002A0000000800000000"))
    return F.concat(F.substring(whole, 1, 11), seg(bare), seg(_tiff(d)), seg(_tiff(d + 1)), F.substring(whole, 12, F.octet_length(whole)))


_GPS_SQL = "(doc_id % 90) || '°' || (doc_id % 60) || '''' || printf('%.0f', round_even((doc_id % 120) / 2.0, 0)) || '\"S, ' || (doc_id % 180) || '°' || (doc_id % 59) || '''' || printf('%.0f', round_even((doc_id % 118) / 2.0, 0)) || '\"E'"


@query("agg_first_gps", f"select doc_id, {_GPS_SQL} as first_gps from documents")
def agg_first_gps(spark, sf):
    """The first position of each file, read from its own bytes."""
    files = _docs(spark, sf).select(F.concat("doc_id", F.lit(".jpg")).alias("path"), _jpeg_with_gps(F.col("text"), F.col("doc_id")).alias("content"))
    return clean.removed_lists(clean.findings(files)).select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), F.col("place").alias("first_gps"))


_MIXED = {0: ".docx", 1: ".odt", 2: ".jpg", 3: ".png", 4: ".webp", 5: ".svg", 6: ".txt"}


def _mixed_files(spark, sf) -> DataFrame:
    """(path, content): a file of each document, of seven formats."""
    docs = fx.table(spark, sf, f"select doc_id, text, case when doc_id % 7 = 5 then {fx.SVG_TEXT} end as svg, case doc_id % 7 when 0 then {OFFICE} when 1 then {OPEN} end as parts from documents", dealt=True)
    kind, text, d = F.col("doc_id") % 7, F.col("text"), F.col("doc_id")
    ext = F.element_at(F.create_map(*[F.lit(x) for pair in _MIXED.items() for x in pair]), kind.cast("int"))
    made = F.when(kind == 2, _jpeg_with_gps(text, d)).when(kind == 3, _png(text, True)).when(kind == 4, _webp(text, True)).when(kind == 5, F.encode("svg", "UTF-8")).when(kind == 6, F.encode("text", "UTF-8"))
    files = archives.pack_lists(docs.select(F.struct(F.concat(d, ext).alias("path"), made.alias("made")).alias("file"), "parts"), "file")
    return files.select("file.path", F.coalesce("content", "file.made").alias("content"))


@query("clean_files", f"""with mixed as (
    select doc_id, digest, status, removed, null as error, null as place from ({ORACLES["clean_office"]}) where doc_id % 7 = 0
    union all select doc_id, digest, status, removed, null, null from ({ORACLES["clean_odf"]}) where doc_id % 7 = 1
    union all select doc_id, md5({D_JPEG}), 'ok', 'EXIF metadata; GPS location (' || {_GPS_SQL} || '); embedded comment; Photoshop metadata (layers/paths/IPTC)', null, {_GPS_SQL} from documents where doc_id % 7 = 2
    union all select doc_id, null, 'ok', '1 text chunk(s); modification timestamp; 1 unknown chunk(s)', null, null from documents where doc_id % 7 = 3
    union all select doc_id, md5({D_WEBP}), 'ok', 'EXIF metadata; XMP metadata', null, null from documents where doc_id % 7 = 4
    union all select doc_id, clean, status, replace(replace(removed, 'block, ', 'block; '), '(s), ', '(s); '), null, null from ({ORACLES["clean_svg"]}) where doc_id % 7 = 5
    union all select doc_id, null, 'skipped', '', 'unsupported file type: .txt', null from documents where doc_id % 7 = 6)
  select doc_id, digest, status, removed, error, place from mixed""")
def clean_files(spark, sf):
    """A mixed folder in one pass; of PNG the bytes are compared by png_strip, as DuckDB has no checksum of chunks."""
    at = _scratch(spark)
    clean.clean_files(_mixed_files(spark, sf)).withColumn("doc_id", F.substring_index("path", ".", 1).cast("long")).write.parquet(at)
    done = spark.read.parquet(at)
    digest = _parts_digest(done.filter("doc_id % 7 < 2")).select("doc_id", "digest").unionByName(done.filter("doc_id % 7 >= 2").select("doc_id", F.when(F.col("doc_id") % 7 != 3, F.md5("new_content")).alias("digest")))
    return done.select("doc_id", "status", F.array_join("removed", "; ").alias("removed"), "error", "place").join(digest, "doc_id")


@query("agg_progress", f"select count(*) filter (where status in ('ok', 'clean')) as done, count(*) filter (where status not in ('ok', 'clean')) as pending from {D_RESULTS}")
def agg_progress(spark, sf):
    return reports.progress(_results(spark, sf))


_NAMED = f"(select distinct on (path) doc_id, path, base, ext from {D_PATHS} order by path, doc_id)"


@query("name_outputs", f"""with f as (select path, 'out/' || left(base, length(base) - length(ext)) || '_clean' as head, ext, case when doc_id % 7 = 3 then 'error' else 'ok' end as status from {_NAMED}),
  taken as (select distinct head, ext, k from f, (select unnest([0, 2]) as k) where right(head, 7) = '1_clean'),
  g as (select *, row_number() over (partition by head, ext order by path) - 1 as r from f where status = 'ok'),
  n as (select path, r + (case when right(head, 7) = '1_clean' then (case when r = 0 then 1 else 2 end) else 0 end) as n, head, ext, status from g union all select path, 0, head, ext, status from f where status <> 'ok')
  select path, status, head || (case when n = 0 then '' else '_' || n end) || ext as dst from n""")
def name_outputs(spark, sf):
    f = _files(spark, sf).groupBy("path").agg(F.min("doc_id").alias("doc_id")).select("path", F.when(F.col("doc_id") % 7 == 3, "error").otherwise("ok").alias("status"))
    stem, ext = paths.stem(F.col("path")), paths.ext(F.col("path"))
    taken = f.filter(stem.endswith("1")).select(F.explode(F.array(F.concat(F.lit("out/"), stem, F.lit("_clean"), ext), F.concat(F.lit("out/"), stem, F.lit("_clean_2"), ext))).alias("path"))
    return reports.name_outputs(f, taken, out_dir="out")


@query("report_summary_line", f"select string_agg(status || ': ' || n, '  ' order by status) as line from (select status, count(*) as n from {D_RESULTS} group by status)")
def report_summary_line(spark, sf):
    return reports.summary_line(_results(spark, sf)).select("line")


@query("sink_report_text", f"""select section, seq, n, line from (
  select 1 as section, path as seq, unnest(range(4))::int as n, unnest(['  ' || list_last(string_split(path, '/')), '      status : ' || status, '      result : ' || coalesce(case when doc_id % 2 = 0 then 'd' end, '—'), '']) as line from {D_RESULTS}
  union all select 0, '', unnest(range(3))::int, unnest(['metascrub sanitization report', repeat('=', 62), ''])
  union all select 2, '', unnest(range(3))::int, unnest([repeat('-', 62), 'Total files: ' || (select count(*) from {D_RESULTS}) || '   (' || (select string_agg(status || ': ' || k, '  ' order by status) from (select status, count(*) as k from {D_RESULTS} group by status)) || ')', 'Originals were never modified.']))""")
def sink_report_text(spark, sf):
    return reports.report_lines(_results(spark, sf).withColumn("details", F.when(F.col("doc_id") % 2 == 0, "d")))


@query("sink_outputs", f"select path, dst, md5(path) as digest from {D_RESULTS} where status in ('ok', 'clean')")
def sink_outputs(spark, sf):
    folder = _scratch(spark)
    fs.write_outputs(_results(spark, sf).filter("status in ('ok', 'clean')").withColumn("content", F.col("path").cast("binary")), folder)
    return spark.read.parquet(folder).select("path", "dst", F.md5("content").alias("digest"))


@query("fn_summary", f"""select doc_id, case status when 'ok' then (case when doc_id % 2 = 0 then 'a, b' else 'metadata removed' end) when 'clean' then 'no metadata found' when 'skipped' then 'unsupported file type' else (case when doc_id % 3 = 0 then 'boom' else 'failed' end) end as summary from {D_RESULTS}""")
def fn_summary(spark, sf):
    r = _results(spark, sf).withColumns({"removed": F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")), "error": F.when(F.col("doc_id") % 3 == 0, "boom").otherwise("")})
    return reports.summary(r).select("doc_id", "summary")


_KB = lambda p: f"printf('%.1f', round_even(n / {1 << p}::double, 1))"


@query("fn_fmt_bytes", f"select doc_id, case when n >= {1 << 30} then {_KB(30)} || ' GB' when n >= {1 << 20} then {_KB(20)} || ' MB' when n >= 1024 then {_KB(10)} || ' KB' else n || ' B' end as told from (select doc_id, n_chars * n_chars * (doc_id % 50) as n from documents)")
def fn_fmt_bytes(spark, sf):
    return _docs(spark, sf).select("doc_id", texts.fmt_bytes(F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 50)).alias("told"))


@query("fn_status_label", f"select doc_id, case status when 'ok' then '✓' when 'clean' then '✓' when 'skipped' then '–' else '✗' end as label from {D_RESULTS}")
def fn_status_label(spark, sf):
    return _results(spark, sf).select("doc_id", texts.status_label(F.col("status")).alias("label"))


_JSONS = ['{"suffix": "_x", "strip_icc": true}', '{"suffix": "a/b:c", "topmost": "yes"}', "not json", "[1]", '{"suffix": "", "remove_scripts": false}', '{"suffix": 5, "subfolder": 1}', '{"k": 1, "keep_attachments": true}']


@query("fn_options", "select doc_id, ['_x', 'abc', '_clean', '_clean', '_clean', '_clean', '_clean'][doc_id % 7 + 1] as suffix, doc_id % 7 = 0 as strip_icc, doc_id % 7 <> 4 as remove_scripts, false as topmost, doc_id % 7 = 6 as keep_attachments from documents")
def fn_options(spark, sf):
    json = F.get(F.array(*map(F.lit, _JSONS)), (F.col("doc_id") % 7).cast("int"))
    return _docs(spark, sf).withColumn("j", json).select("doc_id", *[texts.option(F.col("j"), k).alias(k) for k in ("suffix", "strip_icc", "remove_scripts", "topmost", "keep_attachments")])


# --- streaming

@query("stream_scrub", _scrub_sql("pages", "page_id", "html"))
def stream_scrub(spark, sf):
    at = _scratch(spark)
    pages = _pages(spark, sf)
    pages.select("page_id", "html").write.parquet(f"{at}/in")
    stream = dropbox.arrivals(spark, f"{at}/in", pages.select("page_id", "html").schema, "parquet")
    dropbox.start(dropbox.scrub(stream, "html").select("page_id", F.md5("html").alias("clean"), F.array_join("removed", ", ").alias("removed"), "status"), f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_dedup", f"select distinct path from {D_FILES}")
def stream_dedup(spark, sf):
    at = _scratch(spark)
    f = _files(spark, sf).select("path")
    f.write.parquet(f"{at}/in")
    dropbox.start(dropbox.once(dropbox.arrivals(spark, f"{at}/in", f.schema, "parquet")), f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_status_counts", f"select status, count(*) as n_files, sum(case when status in ('ok', 'clean') then greatest(src_size - out_size, 0) else 0 end)::bigint as bytes_saved from {D_RESULTS} group by status")
def stream_status_counts(spark, sf):
    at = _scratch(spark)
    r = _results(spark, sf).select("path", "status", "src_size", "out_size")
    r.write.parquet(f"{at}/in")
    dropbox.start_counts(dropbox.arrivals(spark, f"{at}/in", r.schema, "parquet"), f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_clean", f"select doc_id, status, removed, error, case when status = 'ok' then doc_id || '_clean' || ['.docx', '.odt', '.jpg', '.png', '.webp', '.svg', '.txt'][doc_id % 7 + 1] end as dst from ({ORACLES['clean_files']})")
def stream_clean(spark, sf):
    """The drop box over real files of all formats, in several batches."""
    at = _scratch(spark)
    fs.write_copies(_mixed_files(spark, sf).select(F.col("path").alias("dst"), "content"), f"{at}/in")
    box = dropbox.DropBox(spark, f"{at}/out", f"{at}/book")
    box.start(f"{at}/in", f"{at}/log", per_trigger=2000).awaitTermination()
    told = box.reports().select(paths.base(F.col("path")).alias("name"), "status", F.array_join("removed", "; ").alias("removed"), "error", paths.base(F.col("dst")).alias("dst"))
    return told.select(F.substring_index("name", ".", 1).cast("long").alias("doc_id"), "status", "removed", "error", "dst")


_EVENTS = " union all ".join(
    f"select source || '/' || doc_id as path, cast({at} as bigint) as seen, {event} as event, cast({attempt} as int) as attempt, {status} as status from documents where {where}"
    for at, event, attempt, status, where in [
        ("0", "'add'", "null", "cast(null as varchar(9))", "true"), ("1", "'start'", "0", "cast(null as varchar(9))", "doc_id % 5 > 0"), ("2", "'finish'", "0", "case when n_chars % 2 = 0 then 'ok' else 'error' end", "doc_id % 5 > 1"),
        ("2 + n_chars % 3", "case doc_id % 4 when 0 then 'retry' when 1 then 'reclean' else 'clear' end", "null", "cast(null as varchar(9))", "doc_id % 3 > 0"), ("5", "'start'", "1", "cast(null as varchar(9))", "doc_id % 7 = 3"), ("6", "'finish'", "1", "'ok'", "doc_id % 14 = 3"),
    ]
)
_COMMAND = "event in ('retry', 'reclean', 'clear')"


@query("stream_requeue", f"""with g as (select path, max(attempt) filter (event = 'start') as started, max(attempt) filter (event = 'finish') as fa, arg_max(seen, attempt) filter (event = 'finish') as fat, arg_max(status, attempt) filter (event = 'finish') as status,
    max(seen) filter ({_COMMAND}) as ca, arg_max(event, seen) filter ({_COMMAND}) as c from ({_EVENTS}) group by path)
  select path, status, case when started > coalesce(fa, -1) then 'working' when ca > coalesce(fat, -1) then (case c when 'clear' then 'cleared' else 'pending' end) when fa is not null then 'done' else 'pending' end as state,
    (case when started > coalesce(fa, -1) then started when ca > coalesce(fat, -1) and c <> 'clear' then coalesce(fa + 1, 0) else coalesce(fa, 0) end)::int as attempt from g""")
def stream_requeue(spark, sf):
    """A log that is out of order and in part told twice, in three batches."""
    at = _scratch(spark)
    log = fx.table(spark, sf, _EVENTS).withColumnRenamed("seen", "at")
    log = log.unionByName(log.filter(F.crc32(F.col("path").cast("binary")) % 3 == 0))
    log.repartition(3, F.xxhash64("path", "at", "event")).write.parquet(f"{at}/in")
    dropbox.start_requeue(dropbox.arrivals(spark, f"{at}/in", log.schema, "parquet", 1), f"{at}/out", f"{at}/log").awaitTermination()
    return dropbox.queued(spark, f"{at}/out")


@query("reclean_queue", f"select path, attempt + 1 as attempt from {D_RESULTS} where doc_id % 4 in (1, 2)")
def reclean_queue(spark, sf):
    r = _results(spark, sf)
    at = lambda t, c: F.struct(F.lit(t).alias("at"), F.lit(c).alias("command"))
    told = F.when(F.col("doc_id") % 4 == 1, F.array(at(1, "retry"))).when(F.col("doc_id") % 4 == 2, F.array(at(1, "clear"), at(2, "reclean"))).when(F.col("doc_id") % 4 == 3, F.array(at(1, "retry"), at(2, "clear")))
    return dropbox.reclean(r, r.select("path", F.explode(told).alias("c")).select("path", "c.*"))


@query("queue_clear_done", f"select path, status from {D_RESULTS} where status not in ('ok', 'clean')")
def queue_clear_done(spark, sf):
    return reports.unfinished(_results(spark, sf)).select("path", "status")
