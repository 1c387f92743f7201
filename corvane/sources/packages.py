"""Office packages (zip of XML parts): parts, relations, text blocks, alternative texts, identities, links and images as rows.

A small helper turns one part into rows; how parts hang together (slides and
their layouts, charts and notes, sheets and their strings) is joins on
relations. ``corvane.sources.chunks`` builds the chunks of each document.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.patterns import unescaped

SUPPORTED = ("docx", "pptx", "xlsx", "pdf")
#: Bytes of parts that a task gathers before it passes them on; a larger part goes alone and whole.
BATCH_BYTES = 16 << 20
#: Files inside a file whose own parts are read as well: packages by name, and whatever is one by its first bytes.
EMBEDDED = re.compile(r"(^|/)embeddings/[^/]+\.(docx|pptx|xlsx)$")
INSIDE, PACKAGE = re.compile(r"(^|/)embeddings/[^/]+$"), b"PK\x03\x04"
#: How deep packages are opened inside packages, and how many bytes one upload may unpack to; what lies beyond is
#: reported as a part without content.
MAX_DEPTH, MAX_UNPACKED = 4, 1 << 30


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, extension of supported files; others are in rejected_files()."""
    return _named(spark.read.format("binaryFile").load(path)).where(F.col("extension").isin(*SUPPORTED))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """path and extension of files of other types; contents are not read."""
    return _named(spark.read.format("binaryFile").load(path)).where(~F.col("extension").isin(*SUPPORTED)).select("path", "extension")


def _named(files: DataFrame) -> DataFrame:
    return files.select("path", "length", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))


def _opened(content: bytes, prefix: str = "", depth: int = 0, budget: list[int] | None = None) -> Iterator[tuple[str | None, str | None, bytes | None]]:
    """(part, xml, raw) of each entry; those of embedded packages follow under their own name and a bar.

    An entry that would unpack beyond ``MAX_UNPACKED`` bytes of the upload in
    all, or a package deeper than ``MAX_DEPTH``, is a row with its name alone.
    """
    budget = [MAX_UNPACKED] if budget is None else budget
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            for entry in package.infolist():
                budget[0] -= entry.file_size
                if budget[0] < 0:
                    budget[0] += entry.file_size
                    yield prefix + entry.filename, None, None
                    continue
                raw = package.read(entry)
                xml = raw.decode("utf-8", "replace") if entry.filename.endswith((".xml", ".rels")) else None
                yield prefix + entry.filename, xml, None if xml is not None else raw
                if EMBEDDED.search(entry.filename) or (INSIDE.search(entry.filename) and raw.startswith(PACKAGE)):
                    if depth == MAX_DEPTH:
                        yield f"{prefix}{entry.filename}|", None, None
                    else:
                        yield from _opened(raw, f"{prefix}{entry.filename}|", depth + 1, budget)
    except (zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, RuntimeError):
        yield prefix or None, None, None


def parts(files: DataFrame) -> DataFrame:
    """path, part, xml, content of every part, whole; one of xml and content is null; an unreadable file gives one row with a null part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def sent() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["path", "part", "xml", "content"])

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for part, xml, raw in _opened(content.as_py() or b""):
                    rows.append((path.as_py(), part, xml, raw))
                    size += len(xml or raw or b"")
                    if size >= BATCH_BYTES:
                        yield sent()
                        size = 0
        if rows:
            yield sent()

    return files.select("path", "content").mapInArrow(run, "path string, part string, xml string, content binary")


def unopened(rows: DataFrame) -> DataFrame:
    """path and part of what was not read: broken files and packages, and what lies beyond the bounds of unpacking."""
    return rows.where("xml is null and content is null").select("path", "part")


def relations(rows: DataFrame) -> DataFrame:
    """path, owner, id, type (its last word), target (a part's name, or an address outside), external."""
    tags = F.explode(F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?Relationship\b[^>]*>"), F.lit(0))).alias("tag")
    name = r"^(.*?)_rels/([^/]*)\.rels$"
    said = rows.where(F.col("part").rlike(name)).select("path", F.regexp_extract("part", name, 1).alias("folder"), F.regexp_extract("part", name, 2).alias("file"), tags)
    attribute = lambda a: unescaped(F.regexp_extract("tag", rf'\b{a}="([^"]*)"', 1))
    external, target = attribute("TargetMode") == "External", attribute("Target")
    inside = F.regexp_extract("folder", r"^(.*\|)?", 0)
    full = F.when(target.startswith("/"), F.concat(inside, F.substring(target, F.lit(2), F.length(target)))).otherwise(F.concat("folder", target))
    for _ in range(6):
        full = F.regexp_replace(full, r"[^/|]+/\.\./", "")
    return said.select("path", F.concat("folder", "file").alias("owner"), attribute("Id").alias("id"), F.element_at(F.split(attribute("Type"), "/"), -1).alias("type"), F.when(external, target).otherwise(full).alias("target"), external.alias("external"))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _under(e: ElementTree.Element, *names: str, past: tuple[str, ...] = ()) -> Iterator[ElementTree.Element]:
    """Descendants of these local names, in order; nothing below an element of ``past``."""
    for child in e:
        if _local(child) in names:
            yield child
        if _local(child) not in past:
            yield from _under(child, *names, past=past)


def _word_text(paragraph: ElementTree.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join(marks.get(_local(x), x.text or "") for x in _under(paragraph, "t", "tab", "br", "cr", past=("txbxContent", "pPr", "t")))


def _table(table: ElementTree.Element) -> Iterator[str]:
    """Paragraphs cell by cell; tables inside a cell follow its own."""
    for cell in _under(table, "tc", past=("tc",)):
        yield from (_word_text(p).strip() for p in cell if _local(p) == "p")
        for nested in cell:
            if _local(nested) == "tbl":
                yield from _table(nested)


def _word(root: ElementTree.Element, part: str) -> Iterator[tuple[str, int, str]]:
    file = part.rpartition("/")[2]
    if file.startswith(("footnotes", "endnotes")):
        yield from (("note", 0, "".join(t.text or "" for t in _under(p, "t")).strip()) for p in _under(root, "p"))
    elif file.startswith(("header", "footer")):
        yield from (("header_footer", 0, _word_text(p).strip()) for p in root if _local(p) == "p")
    else:
        for body in (x for x in root if _local(x) == "body"):
            yield from (("paragraph", 0, _word_text(p)) for p in body if _local(p) == "p")
            yield from (("table", 0, line) for t in body if _local(t) == "tbl" for line in _table(t))
        for box in _under(root, "txbxContent"):
            yield from (("text_box", 0, "".join(t.text or "" for t in _under(p, "t")).strip()) for p in _under(box, "p"))


def _shapes(root: ElementTree.Element, body_only: bool) -> Iterator[tuple[str, int, str]]:
    """Paragraphs of shapes and of tables' cells, groups included; of notes only the body's."""
    for shape in _under(root, "sp", "graphicFrame", past=("sp", "graphicFrame")):
        if body_only and not any(_attribute(ph, "type") == "body" for ph in _under(shape, "ph")):
            continue
        for p in _under(shape, "p", past=("p",)):
            yield "line", 0, "".join(t.text or "" for r in p if _local(r) == "r" for t in r if _local(t) == "t").strip()


def _sheet(root: ElementTree.Element) -> Iterator[tuple[str, int, str]]:
    """Header and footer texts, then cells: row, kind of value and value."""
    for e in _under(root, "oddHeader", "evenHeader", "firstHeader", "oddFooter", "evenFooter", "firstFooter"):
        for side in re.split(r"&[LCR]", e.text or ""):
            yield "header", 0, re.sub(r'&"[^"]*"|&\d+|&K[0-9A-Fa-f]{6}', "", side).strip()
    for n, row in enumerate(_under(root, "row", past=("row",))):
        for cell in _under(row, "c", past=("c",)):
            kind = cell.get("t", "n")
            said = "".join(t.text or "" for t in _under(cell, "t" if kind == "inlineStr" else "v"))
            if kind == "b":
                said = {"1": "True", "0": "False"}.get(said, said)
            yield "shared" if kind == "s" else "cell", n, said.strip()


def _blocks(part: str, root: ElementTree.Element) -> Iterator[tuple[str, int, str]]:
    """(kind, row, text) of one part, in order."""
    name = part.rpartition("|")[2]
    if re.match(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$", name):
        yield from _word(root, name)
    elif m := re.match(r"ppt/(slides|slideLayouts|slideMasters|notesSlides)/", name):
        yield from _shapes(root, m[1] == "notesSlides")
        if root.get("showMasterSp") in ("0", "false"):
            yield "hides", 0, "master"
    elif name == "ppt/presentation.xml":
        yield from (("slide_id", 0, next((v for k, v in e.attrib.items() if k.endswith('}id')), '')) for e in _under(root, "sldId"))
    elif re.match(r"ppt/charts/chart[^/]*\.xml$", name):
        # Values of number caches are data; all other cached values are labels, also those that look like numbers.
        yield from (("line", 0, (e.text or "").strip()) for e in _under(root, "t", "v", past=("numCache", "numLit")))
        yield from (("line", 0, f"[chart cell ref] {said}") for said in sorted({(e.text or "").strip() for e in _under(root, "f")} - {""}))
    elif re.match(r"ppt/diagrams/data[^/]*\.xml$", name):
        yield from (("line", 0, "".join(t.text or "" for t in _under(p, "t")).strip()) for p in _under(root, "p", past=("p",)))
    elif name == "xl/workbook.xml":
        yield from ((f"sheet {next((v for k, v in e.attrib.items() if k.endswith('}id')), '')}", 0, e.get("name", "")) for e in _under(root, "sheet"))
    elif name == "xl/sharedStrings.xml":
        yield from (("string", n, "".join(t.text or "" for t in _under(si, "t", past=("rPh",)))) for n, si in enumerate(_under(root, "si")))
    elif re.match(r"xl/worksheets/[^/]+\.xml$", name):
        yield from _sheet(root)


def blocks(rows: DataFrame) -> DataFrame:
    """path, part, ord, kind, row, text of every block of text; parts that are no valid XML have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "part", "ord", "kind", "row", "text"]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            for path, part, xml in zip(*(batch.column(c) for c in ("path", "part", "xml"))):
                try:
                    found = list(_blocks(part.as_py(), ElementTree.fromstring(xml.as_py())))
                except ElementTree.ParseError:
                    continue
                out = [(path.as_py(), part.as_py(), n, *block) for n, block in enumerate(found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    wanted = rows.where("xml is not null and part is not null and part not like '%.rels'")
    return wanted.select("path", "part", "xml").mapInArrow(run, "path string, part string, ord int, kind string, row int, text string")


def images(rows: DataFrame) -> DataFrame:
    """path, part, label, format, digest, n_bytes of every image part of word files, decks and workbooks."""
    kind = F.regexp_extract("part", r"^(?:.*\|)?(word|ppt|xl)/media/", 1)
    label = F.create_map(*[F.lit(x) for x in ("word", "document image", "ppt", "slide image", "xl", "sheet image")])[kind]
    return rows.where((kind != "") & F.col("content").isNotNull()).select("path", "part", label.alias("label"), image_format(F.col("content")).alias("format"), F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("n_bytes"))


def media_parts(rows: DataFrame) -> DataFrame:
    """path, part, shown: image parts that a relation shows, and those in media folders that none does."""
    related = relations(rows).where((F.col("type") == "image") & ~F.col("external")).select("path", F.col("target").alias("part")).distinct().withColumn("shown", F.lit(True))
    loose = rows.where(F.col("part").rlike(r"(^|/|\|)media/[^/]+$")).select("path", "part").distinct().join(related, ["path", "part"], "left_anti").withColumn("shown", F.lit(False))
    return related.unionByName(loose)


# What the label of an image part that nothing shows is told by, in order, and the label of all others.
LABELS = (("docProps/thumbnail", "document thumbnail"), ("slideMasters", "slide master graphic"), ("slideLayouts", "slide layout graphic"), ("diagrams", "SmartArt graphic"), ("header", "header graphic"), ("footer", "footer graphic"))
OTHER_LABEL = "embedded image (not reachable from body text)"


def loose_label(part: Column) -> Column:
    """The label of an image part that no relation shows."""
    out = F.lit(None).cast("string")
    for needle, label in reversed(LABELS):
        out = F.when(F.contains(part, F.lit(needle)), label).otherwise(out)
    return F.coalesce(out, F.lit(OTHER_LABEL))


def alt_texts(rows: DataFrame) -> DataFrame:
    """path, part, text: non-blank descriptions and titles of pictures and shapes."""
    tags = F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?(?:cNvPr|docPr)\b[^>]*>"), F.lit(0))
    values = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(r'\b(?:descr|title)="([^"]*)"'), F.lit(1))))
    return rows.select("path", "part", F.explode(F.transform(values, unescaped)).alias("text")).where("trim(text) <> ''")


def identities(rows: DataFrame) -> DataFrame:
    """path, part, value: creator, last modifier and manager fields, and author attributes; a leak whatever they hold."""
    fields = F.when(F.col("part").startswith("docProps/"), F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?(?:creator|lastModifiedBy|manager|Manager)(?: [^>]*)?>(.*?)</"), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))
    authors = F.when(F.lower("part").rlike("comment|author|people|person"), F.regexp_extract_all("xml", F.lit(r'\b(?:\w+:)?(?:author|name|initials|userId|displayName)="([^"]*)"'), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.where("xml is not null").select("path", "part", F.explode(F.transform(F.concat(fields, authors), unescaped)).alias("value")).where("trim(value) <> ''")


def external_links(rows: DataFrame) -> DataFrame:
    """path, part, target of external hyperlinks in relationship parts."""
    links = relations(rows).where(F.col("external") & (F.col("type") == "hyperlink"))
    part = F.concat(F.regexp_extract("owner", r"^(.*/)?", 0), F.lit("_rels/"), F.regexp_extract("owner", r"([^/]*)$", 1), F.lit(".rels"))
    return links.select("path", part.alias("part"), "target")


def comment_parts(rows: DataFrame) -> DataFrame:
    """path, part of every part that holds comments or their authors: by name, or because a relation says so."""
    by_name = rows.select("path", "part").where(F.col("part").rlike(r"(?i)(comment|threadedComment|commentAuthors|/authors|people|persons/)[^/]*\.xml$|xl/persons/"))
    by_relation = relations(rows).where(~F.col("external") & F.col("type").rlike("(?i)comment|author|person|people")).select("path", F.col("target").alias("part"))
    return by_name.unionByName(by_relation.join(rows.select("path", "part"), ["path", "part"], "left_semi")).distinct()


def image_format(content: Column) -> Column:
    """Format by the first bytes; null if unknown."""
    # Magic bytes of image formats.
    magic = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "474946383761"), ("gif", "474946383961"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("wmf", "D7CDC69A"), ("emf", "01000000"), ("emz", "1F8B"))
    out = F.when((F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
    for name, head in magic:
        out = out.when(F.hex(F.substring(content, 1, len(head) // 2)) == head, name)
    return out.when(F.lower(F.substring(content, 1, 256).cast("string")).contains("<svg"), "svg")


def write_chunks_text(chunks: DataFrame, folder: str) -> None:
    """One line per chunk: the label, then the text with its line feeds kept."""
    chunks.select(F.concat(F.lit("=== "), F.col("kind"), F.lit(" "), F.col("chunk_id").cast("string"), F.lit(" ===\n"), F.col("text"), F.lit("\n\n")).alias("value")).write.text(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, replacing what is there."""
    rows.write.mode("overwrite").json(folder)
