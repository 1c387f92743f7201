"""Queries over tracked changes, comments and authors: one word file, deck or workbook for each supplier."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.sources import annotations, packages
from corvane.sources.tables import table

_W, _P, _X = 'xmlns:w="urn:w"', 'xmlns:p="urn:p" xmlns:a="urn:a"', 'xmlns="urn:x"'
NAMES = [("Supplier", "[CLIENT_1]"), ("old deal", "[CLIENT_2]")]


def _parts(key: int, name: str) -> dict[str, str]:
    if key % 3 == 0:
        run = lambda tag, text: f"<w:r><w:{tag}>{text}</w:{tag}></w:r>"
        return {
            "word/document.xml": f'<w:document {_W}><w:body><w:p>{run("t", "Plain " + name)}<w:ins w:id="1" w:author="Ann {key}">{run("t", "new " + name)}</w:ins><w:del w:id="2" w:author="Bob">{run("delText", "the old  deal")}</w:del><w:commentRangeStart w:id="7"/>{run("t", "noted")}<w:commentRangeEnd w:id="7"/>{run("t", "after")}</w:p></w:body></w:document>',
            "word/comments.xml": f'<w:comments {_W}><w:comment w:id="7" w:author="Cy" w:initials=""><w:p>{run("t", "ask " + name)}</w:p></w:comment></w:comments>',
        }
    if key % 3 == 1:
        return {
            "ppt/comments/comment1.xml": f'<p:cmLst {_P}><p:cm authorId="3"><p:text>see {name}</p:text></p:cm></p:cmLst>',
            "ppt/commentAuthors.xml": f'<p:cmAuthorLst {_P}><p:cmAuthor id="3" name="Dee {key}" initials="D"/></p:cmAuthorLst>',
            "ppt/slides/slide1.xml": f"<p:sld {_P}><a:t>{name}</a:t></p:sld>",
        }
    return {
        "xl/comments1.xml": f"<comments {_X}><authors><author>Eve {key}</author></authors><commentList><comment ref='A1' authorId='0'><text><t>old deal of {name}</t></text></comment></commentList></comments>",
        "xl/threadedComments/threadedComment1.xml": f'<ThreadedComments {_X}><threadedComment ref="A1" personId="p1"><text>nothing here</text></threadedComment></ThreadedComments>',
        "xl/persons/person.xml": f'<personList {_X}><person displayName="Flo {key}" id="p1" userId="flo@x"/></personList>',
    }


def _rows(spark, folder):
    def run(batches):
        for batch in batches:
            blobs = []
            for key, name in zip(batch.column("s_suppkey").to_pylist(), batch.column("s_name").to_pylist()):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for part, xml in _parts(key, name).items():
                        z.writestr(part, xml)
                blobs.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("s_name"), pa.array(blobs, pa.binary())], names=["path", "content"])

    return packages.parts(table(spark, folder, "supplier").select("s_suppkey", "s_name").mapInArrow(run, "path string, content binary"))


def annotation_rows(spark, folder):
    """What is annotated, by whom, in which part."""
    return annotations.annotations(_rows(spark, folder)).select("path", "part", "kind", "author", "text")


def residual_annotations(spark, folder):
    """Annotations that still show a name, and authors."""
    found = annotations.residual(annotations.annotations(_rows(spark, folder)), NAMES)
    return found.groupBy("path", "kind", "surface").agg(F.count(F.lit(1)).alias("n"))


def scrubbed_annotations(spark, folder):
    """What the annotations hold after scrubbing: masked texts, no authors."""
    clean = annotations.scrubbed(_rows(spark, folder), NAMES)
    again = annotations.annotations(clean.withColumn("content", F.lit(None).cast("binary")))
    left = again.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "text"))), ";").alias("texts"))
    return clean.groupBy("path").agg(F.sum("changed").alias("changed")).join(left, "path", "left")


_A = """(SELECT s_name AS path, part, kind, author, text FROM supplier, (VALUES
(0, 'word/document.xml', 'author', NULL, 'Ann @K'), (0, 'word/document.xml', 'inserted', 'Ann @K', 'new @N'), (0, 'word/document.xml', 'author', NULL, 'Bob'), (0, 'word/document.xml', 'deleted', 'Bob', 'the old  deal'), (0, 'word/document.xml', 'commented', '7', 'noted'), (0, 'word/comments.xml', 'author', NULL, 'Cy'), (0, 'word/comments.xml', 'comment', 'Cy', 'ask @N'),
(1, 'ppt/comments/comment1.xml', 'comment', '3', 'see @N'), (1, 'ppt/commentAuthors.xml', 'author', NULL, 'Dee @K'), (1, 'ppt/commentAuthors.xml', 'author', NULL, 'D'),
(2, 'xl/comments1.xml', 'author', NULL, 'Eve @K'), (2, 'xl/comments1.xml', 'comment', '0', 'old deal of @N'), (2, 'xl/threadedComments/threadedComment1.xml', 'comment', 'p1', 'nothing here'), (2, 'xl/persons/person.xml', 'author', NULL, 'Flo @K'), (2, 'xl/persons/person.xml', 'author', NULL, 'flo@x')) AS v(place, part, kind, author, text) WHERE s_suppkey % 3 = place)"""
_FILLED = "(SELECT path, part, kind, replace(author, '@K', k) AS author, replace(replace(text, '@K', k), '@N', path) AS text FROM (SELECT a.*, s_suppkey::VARCHAR AS k FROM @A a JOIN supplier ON s_name = path))".replace("@A", _A)
_DEAL = r"old\s+deal"
ORACLE = {
    "annotation_rows": f"SELECT * FROM {_FILLED} f",
    "residual_annotations": (
        f"SELECT path, kind, surface, count(*)::BIGINT AS n FROM (SELECT path, kind, NULL AS surface FROM {_FILLED} f WHERE kind = 'author' UNION ALL "
        f"SELECT path, kind, 'Supplier' FROM {_FILLED} f WHERE kind <> 'author' AND contains(text, 'Supplier') UNION ALL SELECT path, kind, 'old deal' "
        f"FROM {_FILLED} f WHERE kind <> 'author' AND regexp_matches(text, '{_DEAL}')) x GROUP BY ALL"
    ),
    "scrubbed_annotations": (
        f"SELECT path, count(*) FILTER (kind = 'author' OR contains(text, 'Supplier') OR regexp_matches(text, '{_DEAL}'))::BIGINT AS changed, "
        f"string_agg(kind || '=' || regexp_replace(replace(text, 'Supplier', '[CLIENT_1]'), '{_DEAL}', '[CLIENT_2]'), ';' "
        f"ORDER BY kind || '=' || regexp_replace(replace(text, 'Supplier', '[CLIENT_1]'), '{_DEAL}', '[CLIENT_2]')) FILTER (kind <> 'author') AS texts "
        f"FROM {_FILLED} f GROUP BY path"
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE}
