"""Queries over office packages, made of rows of the tables so that both engines have the same input."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.operators import scrub
from corvane.sources import chunks, packages
from corvane.sources.shared import materialize
from corvane.sources.tables import table

_NS = 'xmlns:w="urn:w" xmlns:p="urn:p" xmlns:a="urn:a" xmlns:c="urn:c" xmlns:r="urn:r"'
_PNG = bytes.fromhex("89504E470D0A1A0A")


def _relations(*rows: tuple[str, str, str]) -> str:
    tags = "".join(f'<Relationship Id="rId{n}" Type="http://x/{kind}" Target="{target}"{mode}/>' for n, (kind, target, mode) in enumerate(rows, 1))
    return f'<Relationships xmlns="urn:x">{tags}</Relationships>'


def _shape(text: str, more: str = "") -> str:
    return f'<p:sp>{more}<p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p><a:p/></p:txBody></p:sp>'


def _tree(kind: str, body: str, attributes: str = "") -> str:
    return f"<p:{kind} {_NS}{attributes}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:{kind}>"


def _word(key: int, name: str) -> dict[str, str | bytes]:
    p = lambda text: f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    cells = f"<w:tc>{p('A ' + name)}</w:tc><w:tc>{p('B ' + name)}<w:tbl><w:tr><w:tc>{p('inner ' + name)}</w:tc></w:tr></w:tbl></w:tc>"
    body = "".join(p(f"{name} p{n}") for n in range(1, 11)) + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl><w:p><w:r><w:pict><w:txbxContent>{p('Box ' + name)}</w:txbxContent></w:pict></w:r></w:p>"
    return {
        "word/document.xml": f"<w:document {_NS}><w:body>{body}</w:body></w:document>",
        "word/footer1.xml": f"<w:ftr {_NS}>{p('Footer of ' + name)}</w:ftr>",
        "word/header1.xml": f"<w:hdr {_NS}>{p('Header of ' + name)}</w:hdr>",
        "word/footnotes.xml": f"<w:footnotes {_NS}><w:footnote>{p('Note ' + name)}</w:footnote></w:footnotes>",
        "word/remarks.xml": f'<w:comments {_NS}><w:comment w:author="{name}"/></w:comments>',
        "word/_rels/document.xml.rels": _relations(("comments", "remarks.xml", "")),
        "word/media/image1.png": _PNG + bytes([key % 256]),
    }


def _deck(key: int, name: str) -> dict[str, str | bytes]:
    hides = ' showMasterSp="0"'
    table = f"<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>Cell {name}</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst><si><t>Inside {name}</t></si></sst>")
    return {
        "ppt/presentation.xml": f'<p:presentation {_NS}><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _relations(("slide", "slides/slide1.xml", ""), ("slide", "/ppt/slides/slide2.xml", "")),
        "ppt/slides/slide1.xml": _tree("sld", f'<p:pic><p:cNvPr id="1" descr="Logo of {name}" title=""/></p:pic>' + _shape(f"First {name}") + table),
        "ppt/slides/slide2.xml": _tree("sld", _shape(f"Second {name}") + f"<p:grpSp><p:grpSp>{_shape('R&amp;D of ' + name)}</p:grpSp></p:grpSp>", hides if key % 2 == 0 else ""),
        "ppt/slides/_rels/slide1.xml.rels": _relations(("slideLayout", "../slideLayouts/slideLayout1.xml", ""), ("chart", "../charts/chart1.xml", ""), ("notesSlide", "../notesSlides/notesSlide1.xml", ""), ("package", "../embeddings/book.xlsx", ""), ("image", "../media/image1.jpg", ""), ("hyperlink", f"https://{name.lower()}.example.org/", ' TargetMode="External"')),
        "ppt/slides/_rels/slide2.xml.rels": _relations(("slideLayout", "../slideLayouts/slideLayout1.xml", "")),
        "ppt/slideLayouts/slideLayout1.xml": _tree("sldLayout", _shape(f"Layout {name}"), hides if key % 5 == 0 else ""),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _relations(("slideMaster", "../slideMasters/slideMaster1.xml", "")),
        "ppt/slideMasters/slideMaster1.xml": _tree("sldMaster", _shape(f"Master {name}")),
        "ppt/charts/chart1.xml": f"<c:chart {_NS}><a:t>Chart {name}</a:t><c:cat><c:strRef><c:f>Data {name}!$A$2</c:f><c:strCache><c:pt><c:v>North {name}</c:v></c:pt><c:pt><c:v>2024</c:v></c:pt></c:strCache></c:strRef></c:cat><c:val><c:numRef><c:f>Data {name}!$A$2</c:f><c:numCache><c:pt><c:v>12.5</c:v></c:pt></c:numCache></c:numRef></c:val></c:chart>",
        "ppt/notesSlides/notesSlide1.xml": _tree("notes", _shape("7", '<p:nvPr><p:ph type="sldNum"/></p:nvPr>') + _shape(f"Notes {name}", '<p:nvPr><p:ph type="body"/></p:nvPr>')),
        "ppt/embeddings/book.xlsx": book.getvalue(),
        "ppt/authors.xml": f'<p188:author name="{name}" initials="" userId="u{key}"/>',
        "ppt/media/image1.jpg": bytes.fromhex("FFD8FF00"),
    }


def _book(key: int, name: str) -> dict[str, str | bytes]:
    return {
        "xl/workbook.xml": f'<workbook {_NS}><sheets><sheet name="Data {name}" r:id="rId1"/><sheet name="Other" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(("worksheet", "worksheets/sheet1.xml", ""), ("worksheet", "worksheets/sheet2.xml", "")),
        "xl/sharedStrings.xml": f"<sst><si><t>{name}</t></si><si><r><t>R&amp;</t></r><r><t>D</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c/></row><row><c><v>{key}</v></c><c t="inlineStr"><is><t>in</t></is></c><c t="b"><v>1</v></c></row></sheetData><headerFooter><oddHeader>&amp;LLeft {name}&amp;C&amp;"Arial,Bold"Mid</oddHeader></headerFooter></worksheet>',
        "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
        "xl/threadedComments/threadedComment1.xml": "<ThreadedComments/>",
    }


def _files(spark, folder):
    """One small file per supplier, built from its row: a word file, a deck or a workbook in turn."""

    def run(batches):
        for batch in batches:
            blobs = []
            for key, name in zip(batch.column("s_suppkey").to_pylist(), batch.column("s_name").to_pylist()):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for part, content in (_word, _deck, _book)[key % 3](key, name).items():
                        z.writestr(part, content)
                    z.writestr("docProps/core.xml", f"<cp:coreProperties><dc:creator>{name if key % 2 else ''}</dc:creator></cp:coreProperties>")
                blobs.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("s_name"), pa.array(blobs, pa.binary())], names=["path", "content"])

    # A row becomes a file, so the rows of one small file are dealt to all cores.
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name").repartition(spark.sparkContext.defaultParallelism * 3, "s_suppkey")
    return rows.mapInArrow(run, "path string, content binary")


def package_chunks(spark, folder):
    return chunks.text_chunks(packages.parts(_files(spark, folder)))


def package_alt_texts(spark, folder):
    return packages.alt_texts(packages.parts(_files(spark, folder))).select("path", "text")


def package_identities(spark, folder):
    return packages.identities(packages.parts(_files(spark, folder))).select("path", "part", "value")


def package_links(spark, folder):
    return packages.external_links(packages.parts(_files(spark, folder)))


def package_images(spark, folder):
    return packages.images(packages.parts(_files(spark, folder)))


def package_comment_parts(spark, folder):
    return packages.comment_parts(packages.parts(_files(spark, folder)))


def package_media(spark, folder):
    return packages.media_parts(packages.parts(_files(spark, folder)))


def package_scrubbed(spark, folder):
    """What a scrubbed package still tells: alternative texts, link targets and identities."""
    parts = materialize(packages.parts(_files(spark, folder)).select("path", "part", "xml"), "package-parts")
    words, part = [("Logo", "[LOGO]"), ("example", "[SITE]")], F.col("part")
    xml = F.when(part.endswith(".rels"), scrub.scrubbed_links(F.col("xml"), words)).when(part.startswith("docProps/"), scrub.scrubbed_metadata(F.col("xml"), ["creator"], ["title"], words)).otherwise(scrub.scrubbed_attributes(F.col("xml"), ["descr", "title"], words))
    clean = parts.withColumn("xml", xml)
    told = packages.alt_texts(clean).select("path", "text").unionByName(packages.external_links(clean).select("path", F.col("target").alias("text")))
    return told.unionByName(packages.identities(clean.where(part.startswith("docProps/"))).select("path", F.col("value").alias("text")))


def redacted_parts(spark, folder):
    """How many different image parts each kind of document covers."""
    return package_images(spark, folder).groupBy("label").agg(F.countDistinct("part").alias("parts"), F.countDistinct("digest").alias("images"))


_N = "chr(10)"
_WORD = [
    ("paragraph_group", 0, "paragraphs 1-8", f"array_to_string(list_transform(generate_series(1, 8), lambda i: n || ' p' || i), {_N} || {_N})"),
    ("paragraph_group", 1, "paragraphs 9-10", f"n || ' p9' || {_N} || {_N} || n || ' p10'"),
    ("header_footer", -1, "headers & footers", f"'Header of ' || n || {_N} || 'Footer of ' || n"),
    ("text_boxes", -2, "text boxes", "'Box ' || n"),
    ("notes", -3, "footnotes & endnotes", "'Note ' || n"),
    ("tables", 5, "tables", f"'A ' || n || {_N} || 'B ' || n || {_N} || 'inner ' || n"),
]
_BOTH = "CASE WHEN k % 2 = 1 THEN '[slide 1 {0}] {1} ' || n || chr(10) ELSE '' END || '[slide 2 {0}] {1} ' || n"
_DECK = [
    ("slide", 0, "slide 1", f"'Second ' || n || {_N} || 'R&D of ' || n"),
    ("slide", 1, "slide 2", f"'First ' || n || {_N} || 'Cell ' || n"),
    ("chart", 2, "chart text", f"'[slide 2 chart] Chart ' || n || {_N} || '[slide 2 chart] North ' || n || {_N} || '[slide 2 chart] 2024' || {_N} || '[slide 2 chart] [chart cell ref] Data ' || n || '!$A$2'"),
    ("ole", 3, "embedded objects", "'[slide 2 embedded object] Inside ' || n"),
    ("layout-text", 4, "layout text", _BOTH.format("layout", "Layout")),
    ("master-text", 5, "master text", f"CASE WHEN k % 5 <> 0 THEN {_BOTH.format('master', 'Master')} END"),
    ("notes", "CASE WHEN k % 5 <> 0 THEN 6 ELSE 5 END", "speaker notes", "'[slide 2 notes] Notes ' || n"),
]
_BOOK = [
    ("sheet", 0, None, f"'Data ' || n || {_N} || 'Left ' || n || {_N} || 'Mid' || {_N} || n || ' | R&D' || {_N} || k || ' | in | True'"),
    ("sheet", 1, "sheet ''Other''", "'Other'"),
]


def _expected(rows: list, turn: int) -> str:
    label = lambda x: "'sheet ''Data ' || n || chr(39)" if x is None else f"'{x}'"
    return " UNION ALL ".join(f"SELECT n AS path, '{kind}' AS kind, ({at})::INTEGER AS chunk_id, {label(name)} AS label, {text} AS text FROM f WHERE k % 3 = {turn}" for kind, at, name, text in rows)


def loose_labels(spark, folder):
    """Labels of image parts that nothing shows: one part of some folder for each supplier."""
    folders = F.array(*[F.lit(x) for x in ("docProps/thumbnail", "ppt/slideMasters/media/", "ppt/slideLayouts/media/", "ppt/diagrams/media/", "word/media/header", "word/media/footer_of_header", "ppt/media/footer", "xl/media/")])
    part = F.concat(F.element_at(folders, (F.col("s_suppkey") % 8 + 1).cast("int")), F.col("s_suppkey"), F.lit(".png"))
    return table(spark, folder, "supplier").select("s_suppkey", packages.loose_label(part).alias("label"))


ORACLE = {
    "loose_labels": (
        f"SELECT s_suppkey, ['document thumbnail', 'slide master graphic', 'slide layout graphic', 'SmartArt graphic', 'header graphic', 'header graphic', "
        f"'footer graphic', '{packages.OTHER_LABEL}'][s_suppkey % 8 + 1] AS label FROM supplier"
    ),
    "package_chunks": (
        f"WITH f AS (SELECT s_suppkey AS k, s_name AS n FROM supplier) SELECT * FROM ({_expected(_WORD, 0)} UNION ALL {_expected(_DECK, 1)} "
        f"UNION ALL {_expected(_BOOK, 2)}) x WHERE text IS NOT NULL"
    ),
    "package_alt_texts": "SELECT s_name AS path, 'Logo of ' || s_name AS text FROM supplier WHERE s_suppkey % 3 = 1",
    "package_identities": (
        "SELECT s_name AS path, 'docProps/core.xml' AS part, s_name AS value FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_name, 'ppt/authors.xml', "
        "unnest([s_name, 'u' || s_suppkey]) FROM supplier WHERE s_suppkey % 3 = 1"
    ),
    "package_links": (
        "SELECT s_name AS path, 'ppt/slides/_rels/slide1.xml.rels' AS part, 'https://' || lower(s_name) || '.example.org/' AS target FROM supplier "
        "WHERE s_suppkey % 3 = 1"
    ),
    "package_images": (
        "SELECT s_name AS path, 'word/media/image1.png' AS part, 'document image' AS label, 'png' AS format, "
        "sha256(from_hex('89504E470D0A1A0A' || lpad(to_hex(s_suppkey % 256), 2, '0'))) AS digest, 9::BIGINT AS n_bytes FROM supplier WHERE s_suppkey % 3 = 0 "
        "UNION ALL SELECT s_name, 'ppt/media/image1.jpg', 'slide image', 'jpeg', sha256(from_hex('FFD8FF00')), 4 FROM supplier WHERE s_suppkey % 3 = 1"
    ),
    "package_media": (
        "SELECT s_name AS path, CASE s_suppkey % 3 WHEN 0 THEN 'word/media/image1.png' ELSE 'ppt/media/image1.jpg' END AS part, s_suppkey % 3 = 1 AS shown "
        "FROM supplier WHERE s_suppkey % 3 < 2"
    ),
    "package_scrubbed": "SELECT s_name AS path, unnest(['[LOGO] of ' || s_name, 'https://' || lower(s_name) || '.[SITE].org/']) AS text FROM supplier WHERE s_suppkey % 3 = 1",
    "redacted_parts": (
        "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'document image' ELSE 'slide image' END AS label, 1::BIGINT AS parts, count(DISTINCT CASE "
        "WHEN s_suppkey % 3 = 0 THEN s_suppkey % 256 ELSE 0 END)::BIGINT AS images FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY ALL"
    ),
    "package_comment_parts": "SELECT s_name AS path, ['word/remarks.xml', 'ppt/authors.xml', 'xl/threadedComments/threadedComment1.xml'][s_suppkey % 3 + 1] AS part FROM supplier",
}
QUERIES = {name: globals()[name] for name in ORACLE}
