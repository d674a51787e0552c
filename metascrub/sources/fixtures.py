"""Tables derived from the driver's documents, in SQL that Spark and DuckDB read alike (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = """select doc_id,
  concat('in/', source, '/', case when doc_id % 2 = 0 then 'a/' else '' end, 'img', doc_id % 25,
    case doc_id % 12 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' when 3 then '.webp' when 4 then '.svg'
      when 5 then '.docx' when 6 then '.xlsx' when 7 then '.odt' when 8 then '.pdf' when 9 then '.txt'
      when 10 then '' else '.tiff' end) as path,
  n_chars * 1000 as length
from documents"""

SVG_TEXT = """concat('<?xml version="1.0"?>',
  case when doc_id % 4 = 0 then '<?xml-stylesheet href="a.css"?>' else '' end, '<svg>',
  case when doc_id % 2 = 0 then concat('<metadata><dc:creator>', source, '</dc:creator></metadata>') else '' end,
  '<!-- ', replace(text, '--', ''), ' -->',
  case when doc_id % 5 = 0 then concat('<dc:title>', lang, '</dc:title>') else '' end,
  case when doc_id % 7 = 0 then '<image href="data:image/png;base64,AAAA"/>' else '' end,
  case when doc_id % 3 = 0 then '<script>x()</script>' else '' end, '<circle r="', doc_id % 9, '"/></svg>')"""
SVG = f"select doc_id, {SVG_TEXT} as svg from documents"

#: Text of a document that is safe inside markup.
BODY = "replace(replace(replace(replace(text, '<', ''), '>', ''), '\"', ''), chr(10), ' ')"

PART_NAMES = [
    "docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "word/comments.xml", "word/commentAuthors.xml", "word/commentsExtended.xml",
    "word/commentsIds.xml", "ppt/commentsAuthors.xml", "ppt/comments/c1.xml", "ppt/notesSlides/n1.xml", "xl/externalLinks/e1.xml", "xl/comments1.xml",
    "xl/authors.xml", "_xmlsignatures/s1.xml", "word/vbaProject.bin", "customXml/item1.xml", "word/media/a.wmf", "word/media/b.jpg",
    "word/document.xml", "[Content_Types].xml", "word/_rels/document.xml.rels", "word/theme/", "word/styles.xml", "word/vbaData.xml",
]

ODF_NAMES = ["mimetype", "meta.xml", "content.xml", "settings.xml", "Basic/script.xml", "Scripts/python/a.py", "Thumbnails/t.png", "customUI/ui.xml", "styles.xml"]


def parts_sql(names: list[str], data: str, engine: str) -> str:
    """(doc_id, part_seq, part_name, data): a part for each document and name."""
    listed = ", ".join(f"'{n}'" for n in names)
    if engine == "spark":
        return f"select doc_id, part_seq, part_name, {data} as data from (select *, posexplode(array({listed})) as (part_seq, part_name) from documents)"
    return f"select doc_id, part_seq, part_name, {data} as data from (select *, unnest(range({len(names)}))::int as part_seq, unnest([{listed}]) as part_name from documents)"


def parts_array(names: list[str], data: str) -> str:
    """The parts of ``parts_sql`` as an array in one row, for Spark."""
    each = ", ".join(f"named_struct('part_seq', {k}, 'part_name', '{n}', 'data', cast({data.replace('part_seq', str(k))} as binary))" for k, n in enumerate(names))
    return f"array({each})"


OOXML_DATA = f"""case part_seq
  when 0 then concat('<cp:coreProperties><dc:creator>', source, '</dc:creator><dc:title> </dc:title><cp:lastModifiedBy>', lang, '</cp:lastModifiedBy><dcterms:created xsi:type="x">2020</dcterms:created></cp:coreProperties>')
  when 1 then concat('<Properties><Application>Word</Application><Company>', case when doc_id % 2 = 0 then source else '' end, '</Company><TotalTime>1</TotalTime></Properties>')
  when 18 then concat('<w:document><w:p w:rsidR="00A1" w:rsidRPr="0B"><w:ins w:id="1" w:author="', source, '" w:date="2020-01-01"><w:t>', {BODY}, '</w:t></w:ins><w:commentRangeStart w:id="0"/><w:commentRangeEnd w:id="0"/><w:commentReference w:id="0"/></w:p>', case when doc_id % 2 = 0 then '<w:rsids><w:rsid w:val="00"/></w:rsids>' else '' end, '</w:document>')
  when 19 then concat('<Types><Override PartName="/word/vbaProject.bin"/><Override PartName="/customXml/item1.xml"/><Override PartName="/ppt/notesSlides/n', doc_id % 3, '.xml"/><override PartName="/word/comments.xml"/><Override PartName="/xl/externalLinks/e1.xml"/><Override ContentType="a.digsig"/><Override ContentType="xml-signature"/><Override PartName="/word/document.xml"/></Types>')
  when 20 then concat('<Relationships><Relationship Target="vbaProject.bin"/><Relationship Target="../customXml/item1.xml"/><Relationship Target="comments.xml"/><Relationship Target="notesSlide', doc_id % 3, '.xml"/><Relationship Target="commentAuthors.xml"/><Relationship Target="externalLink1.xml"/><Relationship Type="digital-signature"/><Relationship Target="_xmlsignatures/o"/><Relationship Target="styles.xml"/></Relationships>')
  when 22 then concat('<w:styles w:rsidR="1F">', {BODY}, '</w:styles>')
  else concat('<x>', source, '</x>') end"""

ODF_DATA = f"""case part_seq
  when 0 then 'application/vnd.oasis.opendocument.text'
  when 1 then concat('<office:meta><dc:creator>', source, '</dc:creator><meta:initial-creator>', lang, '</meta:initial-creator>', case when doc_id % 2 = 0 then '<dc:title>t</dc:title><meta:document-statistic a="1"/>' else '' end, '</office:meta>')
  when 2 then concat('<text:changed-region a="1"><dc:creator>', source, '</dc:creator></text:changed-region><text:change-start dc:creator="', source, '"/><text:change-start dc:date="2020"/><text:change dc:creator="b"/><text:change dc:date="2021"/>', {BODY}, '<text:change-end a="1"/>', case when doc_id % 3 = 0 then '<text:annotation><dc:creator>x</dc:creator></text:annotation>' else '' end)
  when 3 then concat('<config:config-item config:name="Author">', source, '</config:config-item><config:config-item config:name="Zoom">1</config:config-item><config:config-item config:name="Company">', lang, '</config:config-item>')
  else concat('<x>', source, '</x>') end"""

#: (path with / between, key, value) of one PDF; actions are nodes with an /S child.
PDF_NODES = [
    ("Info", "/Title", "t"), ("Info", "/Author", "a"), ("Root/Names", "/EmbeddedFiles", "dict"), ("Root/Names/EmbeddedFiles", "/Kids", "k"), ("Root", "/Metadata", "xmp"),
    ("Root", "/OpenAction", "dict"), ("Root/OpenAction", "/S", "/JavaScript"), ("Root/OpenAction", "/JS", "app.alert"), ("Root/Pages/0", "/A", "dict"), ("Root/Pages/0/A", "/S", "/GoTo"),
    ("Root/Pages/0", "/AA", "dict"), ("Root/Pages/0/AA", "/O", "dict"), ("Root/Pages/0/AA/O", "/S", "/Launch"), ("Root/Pages/0/AA/O", "/F", "cmd"), ("Root/Pages/0", "/PieceInfo", "dict"), ("Root/Pages/0/PieceInfo", "/AI", "p"),
    ("Root/AcroForm", "/XFA", "x"), ("Root/AcroForm/Fields/0", "/T", "label"), ("Root/AcroForm/Fields/0", "/V", "value"), ("Root/AcroForm/Fields/0", "/DV", "d"), ("Root/AcroForm/Fields/0", "/TU", "tip"),
    ("Root/Pages/0/Annots/0", "/T", "me"), ("Root/Pages/0/Annots/0", "/NM", "id"), ("Root/Pages/0/Annots/0", "/Contents", "c"), ("Root/Pages/0/Annots/0", "/M", "2020"),
    ("Root/Outlines/First", "/Title", "ch"), ("Root/Outlines/First", "/NM", "n"), ("Root/Names", "/JavaScript", "dict"), ("Root/Names/JavaScript", "/Names", "j"), ("Trailer", "/ID", "ff"),
]


def pdf_sql(engine: str) -> str:
    """(doc_id, parent, key, node, value): PDF entries; every third document has none of the last node, and so on."""
    p, k, v = (", ".join(f"'{n[i]}'" for n in PDF_NODES) for i in range(3))
    if engine == "spark":
        src = f"select doc_id, source, i, parent, array({k})[i] as key, array({v})[i] as v from (select *, posexplode(array({p})) as (i, parent) from documents)"
    else:
        src = f"select doc_id, source, unnest(range({len(PDF_NODES)}))::int as i, unnest([{p}]) as parent, unnest([{k}]) as key, unnest([{v}]) as v from documents"
    return f"select doc_id, parent, key, concat(parent, key) as node, case when key = '/Author' then source else v end as value, i as seq from ({src}) where (doc_id + i) % 7 <> 0"


RESULTS = """select doc_id, concat('in/', source, '/f', doc_id, '.png') as path, concat('out/', source, '/f', doc_id, '_clean.png') as dst,
  case doc_id % 5 when 0 then 'ok' when 1 then 'ok' when 2 then 'clean' when 3 then 'skipped' else 'error' end as status,
  n_chars as src_size, n_chars - (doc_id % 11) * 3 + 4 as out_size, doc_id % 3 as attempt
from documents"""


def table(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """The SQL over documents of a folder. dealt: where there are fewer splits than cores, documents are dealt to tasks anew."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if dealt and documents.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        documents = documents.repartition("doc_id")
    return spark.sql(f"select * from ({sql.replace('from documents', 'from {documents}')})", documents=documents)
