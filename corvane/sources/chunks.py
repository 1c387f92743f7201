"""Chunks of office documents, built from blocks and relations by joins and grouping.

Every chunk is a row (path, kind, chunk_id, label, text). Word files: eight
paragraphs each, tables last; headers and footers -1, text boxes -2, notes -3.
Decks: a slide each, then charts, diagrams, embedded files, layout and master
texts that the slide shows, and speaker notes, each line marked with its slide.
Workbooks: a sheet each: its name, print headers and footers, and its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.packages import blocks, relations
from corvane.sources.shared import materialize

PER_CHUNK = 8
COLUMNS = ("path", "kind", "chunk_id", "label", "text")


def _joined(rows: DataFrame, keys: list[str], order: list[str], between: str = "\n") -> DataFrame:
    """Each key's texts in order, as one text."""
    said = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(said, lambda x: x["text"]), between).alias("text"))


def word_chunks(found: DataFrame) -> DataFrame:
    """Chunks of word files from their blocks."""
    rows = found.where(F.col("part").startswith("word/") & (F.trim("text") != ""))
    # The places of the chunks that stand beside the body.
    beside = {"header_footer": (-1, "header_footer", "headers & footers"), "text_box": (-2, "text_boxes", "text boxes"), "note": (-3, "notes", "footnotes & endnotes")}
    place = Window.partitionBy("path").orderBy("ord")
    body = rows.where("kind = 'paragraph'").withColumn("n", F.row_number().over(place) - 1).withColumn("chunk_id", F.floor(F.col("n") / PER_CHUNK).cast("int"))
    first = F.col("chunk_id") * PER_CHUNK + 1
    grouped = body.groupBy("path", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("size"))
    paragraphs = grouped.select("path", F.lit("paragraph_group").alias("kind"), "chunk_id", F.format_string("paragraphs %d-%d", first, (first + F.col("size") - 1).cast("int")).alias("label"), "text")
    rows = rows.withColumn("after", (~F.col("part").rlike("^word/(header|footnotes)")).cast("int"))
    sides = [_joined(rows.where(F.col("kind") == kind), ["path"], ["after", "part", "ord"]).select("path", F.lit(name).alias("kind"), F.lit(at).alias("chunk_id"), F.lit(label).alias("label"), "text") for kind, (at, name, label) in beside.items()]
    out = paragraphs
    for side in sides:
        out = out.unionByName(side)
    # The tables come after all others, so their number is how many there are.
    count = out.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("chunk_id"))
    tables = _joined(rows.where("kind = 'table'"), ["path"], ["ord"]).join(count, "path", "left")
    return out.unionByName(tables.select("path", F.lit("tables").alias("kind"), F.coalesce("chunk_id", F.lit(0)).alias("chunk_id"), F.lit("tables").alias("label"), "text")).select(*COLUMNS)


def slides_of(parts: DataFrame, found: DataFrame, related: DataFrame) -> DataFrame:
    """path, part, number (from 1) of every slide, in the presentation's order; slides that it does not list come last."""
    slides = parts.where(F.col("part").rlike(r"^ppt/slides/[^/]+\.xml$")).select("path", "part", F.regexp_extract("part", r"(\d+)\.xml$", 1).alias("digits"))
    listed = found.where("kind = 'slide_id'").select("path", F.col("text").alias("id"), "ord").join(related.where("owner = 'ppt/presentation.xml'"), ["path", "id"]).select("path", F.col("target").alias("part"), "ord")
    order = Window.partitionBy("path").orderBy(F.col("ord").asc_nulls_last(), F.length("digits"), "digits", "part")
    return slides.join(listed, ["path", "part"], "left").select("path", "part", F.row_number().over(order).alias("number"))


def deck_chunks(parts: DataFrame, found: DataFrame, related: DataFrame) -> DataFrame:
    """Chunks of decks from their blocks and relations.

    A slide that hides master shapes shows neither its layout's nor its
    master's text; a layout that hides them keeps its master's from its slides.
    """
    slides = slides_of(parts, found, related)
    hiding = found.where("kind = 'hides'").select("path", "part").distinct()
    lines = found.where("kind in ('line', 'string', 'paragraph') and text <> ''").select("path", "part", "ord", "text")
    to = lambda *types: related.where(~F.col("external") & F.col("type").isin(*types)).select("path", F.col("owner").alias("part"), F.col("target"), "type")
    shown = slides.join(hiding, ["path", "part"], "left_anti")
    layouts = shown.join(to("slideLayout"), ["path", "part"]).select("path", F.col("target").alias("part"), "number")
    masters = layouts.join(hiding, ["path", "part"], "left_anti").join(to("slideMaster"), ["path", "part"]).select("path", F.col("target").alias("part"), "number")
    places = slides.withColumn("role", F.lit("")).unionByName(layouts.withColumn("role", F.lit(" layout"))).unionByName(masters.withColumn("role", F.lit(" master")))

    mark = lambda what: F.concat(F.format_string("[slide %d%s", "number", "role"), what, F.lit("] "), F.col("text")).alias("text")
    order = ["path", "number", "role"]
    own = places.join(lines, ["path", "part"])
    empty = slides.select("path", "number", F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("text"))
    texts = _joined(own.where("role = ''").select("path", "number", "ord", "text").unionByName(empty), ["path", "number"], ["ord"])
    slide_rows = texts.select("path", F.lit("slide").alias("kind"), (F.col("number") - 1).alias("chunk_id"), F.format_string("slide %d", "number").alias("label"), "text")

    # The kinds of further chunks, in their order, with their labels.
    kinds = (("chart", "chart text"), ("smartart", "smartart text"), ("ole", "embedded objects"), ("layout-text", "layout text"), ("master-text", "master text"), ("notes", "speaker notes"))
    kind_of = F.when(F.col("type") == "chart", "chart").when(F.col("type") == "diagramData", "smartart").otherwise("ole")
    what = F.when(F.col("kind") == "ole", " embedded object").otherwise(F.concat(F.lit(" "), F.col("kind")))
    objects = places.join(to("chart", "diagramData", "oleObject", "package"), ["path", "part"]).select(*order, "target", kind_of.alias("kind"))
    # An embedded file's parts go by its name, a bar and their own.
    inner = lines.withColumn("target", F.regexp_extract("part", r"^([^|]*)", 1))
    said = objects.join(inner, ["path", "target"]).select(*order, "kind", F.col("part").alias("source"), "ord", mark(what))
    inherited = own.where("role <> ''").select(*order, F.when(F.col("role") == " layout", "layout-text").otherwise("master-text").alias("kind"), F.col("part").alias("source"), "ord", mark(F.lit("")))
    noted = _joined(slides.join(to("notesSlide"), ["path", "part"]).select("path", "number", F.col("target").alias("part")).join(lines, ["path", "part"]), ["path", "number"], ["ord"])
    notes = noted.withColumn("role", F.lit("")).select(*order, F.lit("notes").alias("kind"), F.lit("").alias("source"), F.lit(0).alias("ord"), mark(F.lit(" notes")))
    further = _joined(said.unionByName(inherited).unionByName(notes), ["path", "kind"], ["number", "role", "source", "ord"])
    rank = F.array_position(F.array(*[F.lit(kind) for kind, _ in kinds]), F.col("kind"))
    count = slides.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("slides"))
    placed = further.join(count, "path").withColumn("chunk_id", F.col("slides") + F.row_number().over(Window.partitionBy("path").orderBy(rank)) - 1)
    label = F.create_map(*[F.lit(x) for pair in kinds for x in pair])[F.col("kind")]
    return slide_rows.unionByName(placed.select("path", "kind", "chunk_id", label.alias("label"), "text")).select(*COLUMNS)


def sheet_chunks(found: DataFrame, related: DataFrame) -> DataFrame:
    """Chunks of workbooks from their blocks and relations."""
    named = found.where("part = 'xl/workbook.xml' and kind like 'sheet %'").select("path", "ord", F.expr("substring(kind, 7)").alias("id"), F.col("text").alias("name"))
    number = Window.partitionBy("path").orderBy("ord")
    sheets = named.join(related.where("owner = 'xl/workbook.xml'").select("path", "id", F.col("target").alias("part")), ["path", "id"], "left").withColumn("chunk_id", F.row_number().over(number) - 1).drop("ord")
    strings = found.where("part = 'xl/sharedStrings.xml'").select("path", F.col("row").alias("at"), F.trim("text").alias("said"))
    cells = found.where("kind in ('cell', 'shared', 'header')").withColumn("at", F.when(F.col("kind") == "shared", F.expr("try_cast(text as int)")))
    spoken = cells.join(strings, ["path", "at"], "left").withColumn("text", F.when(F.col("kind") == "shared", F.col("said")).otherwise(F.col("text"))).where("text <> ''")
    headers = spoken.where("kind = 'header'").select("path", "part", F.lit(-1).alias("row"), "ord", "text")
    rows = _joined(spoken.where("kind <> 'header'"), ["path", "part", "row"], ["ord"], " | ").withColumn("ord", F.lit(0)).select("path", "part", "row", "ord", "text")
    body = sheets.join(headers.unionByName(rows), ["path", "part"]).select("path", "chunk_id", "name", "row", "ord", "text")
    lines = body.unionByName(sheets.select("path", "chunk_id", "name", F.lit(-2).alias("row"), F.lit(0).alias("ord"), F.col("name").alias("text")))
    texts = _joined(lines, ["path", "chunk_id", "name"], ["row", "ord"])
    return texts.select("path", F.lit("sheet").alias("kind"), "chunk_id", F.concat(F.lit("sheet '"), F.col("name"), F.lit("'")).alias("label"), "text")


def text_chunks(parts: DataFrame) -> DataFrame:
    """path, kind, chunk_id, label, text of every chunk of the packages' parts; the packages are opened, and their parts read, once."""
    parts = materialize(parts.select("path", "part", "xml"), "package-parts")
    found, related = materialize(blocks(parts), "package-blocks"), materialize(relations(parts), "package-relations")
    return word_chunks(found).unionByName(deck_chunks(parts, found, related)).unionByName(sheet_chunks(found, related))

