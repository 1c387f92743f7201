"""Tracked changes, comments and their authors of office packages: a walk over the parts that keeps what stands above."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.automaton import Automaton, claimed
from corvane.operators.spans import replaced
from corvane.sources.packages import _attribute, _local

# The parts that hold annotations, and the attributes and elements that name their authors.
PARTS = (
    r"(^|\|)word/(document|comments|people|header\d*|footer\d*|footnotes|endnotes)\.xml$",
    r"(^|\|)ppt/(comments/(comment\d*|modernComment_[^/]*)|commentAuthors|authors)\.xml$",
    r"(^|\|)xl/(comments\d*|comments/comment\d*|threadedComments/threadedComment\d*|persons/person)\.xml$",
)
AUTHOR_ATTRIBUTES = ("author", "initials", "name", "userId", "displayName")
AUTHOR_OWNERS = ("ins", "del", "moveFrom", "moveTo", "comment", "person", "cmAuthor", "author")
INSERTED, DELETED, COMMENT, COMMENTED, AUTHOR = "inserted", "deleted", "comment", "commented", "author"
_COMMENTS = ("comment", "cm", "threadedComment")


def _walk(root: ElementTree.Element) -> Iterator[tuple[str, str | None, ElementTree.Element, str | None]]:
    """(kind, author, element, attribute) of each annotated text and each author name, in order.

    ``attribute`` is None where the element's own text is meant. Text between
    the marks of a comment's range is told for each comment that is open there.
    """
    open_ranges: list[str] = []

    def below(e: ElementTree.Element, inside: tuple[ElementTree.Element, ...]) -> Iterator:
        name = _local(e)
        if name == "commentRangeStart":
            open_ranges.append(_attribute(e, "id") or "")
        elif name == "commentRangeEnd" and (_attribute(e, "id") or "") in open_ranges:
            open_ranges.remove(_attribute(e, "id") or "")
        if name in AUTHOR_OWNERS:
            for key in e.attrib:
                if key.rpartition("}")[2] in AUTHOR_ATTRIBUTES and e.attrib[key].strip():
                    yield AUTHOR, None, e, key
            if name == "author" and (e.text or "").strip():
                yield AUTHOR, None, e, None
        owner = next((x for x in reversed(inside) if _local(x) in ("ins", "del", "moveFrom", "moveTo", *_COMMENTS)), None)
        if (e.text or "").strip() and name in ("t", "delText", "text") and owner is not None:
            kind = COMMENT if _local(owner) in _COMMENTS else DELETED if name == "delText" or _local(owner) in ("del", "moveFrom") else INSERTED
            yield kind, _attribute(owner, "author") or _attribute(owner, "authorId") or _attribute(owner, "personId"), e, None
        if name == "t" and (e.text or "").strip():
            yield from ((COMMENTED, comment, e, None) for comment in open_ranges)
        for child in e:
            yield from below(child, (*inside, e))

    yield from below(root, ())


def _parsed(xml: str | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(xml) if xml else None
    except ElementTree.ParseError:
        return None


def annotation_parts(rows: DataFrame) -> DataFrame:
    """path, part, xml of the parts (as ``packages.parts`` returns them) that hold annotations."""
    return rows.where(F.col("xml").isNotNull() & F.col("part").rlike("|".join(PARTS))).select("path", "part", "xml")


def annotations(rows: DataFrame) -> DataFrame:
    """path, part, ord, kind, author, text of every annotation; ``author`` of a commented text is the comment's id. Broken parts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, part, xml in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "xml"))):
                if (root := _parsed(xml)) is not None:
                    out += [(path, part, n, kind, author, e.text if key is None else e.attrib[key]) for n, (kind, author, e, key) in enumerate(_walk(root))]
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "part", "ord", "kind", "author", "text"])

    return annotation_parts(rows).mapInArrow(run, "path string, part string, ord int, kind string, author string, text string")


def residual(found: DataFrame, dictionary: list[tuple[str, str]]) -> DataFrame:
    """path, part, ord, kind, surface: annotations in which a surface of (surface, token) stands; authors are residual whatever they hold, with a null surface.

    For a dictionary that is a table use ``automaton.occurrences`` over the same rows.
    """
    aliases = [(i, s, t) for i, (s, t) in enumerate(dictionary)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(aliases)
        for batch in batches:
            at, surfaces = [], []
            for i, (kind, text) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist())):
                own = [None] if kind == AUTHOR else [aliases[a][1] for a in sorted(automaton.found(text))]
                at += [i] * len(own)
                surfaces += own
            rows = batch.select(["path", "part", "ord", "kind"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(surfaces, pa.string())], names=[*rows.schema.names, "surface"])

    return found.mapInArrow(run, "path string, part string, ord int, kind string, surface string")


def scrubbed(rows: DataFrame, dictionary: list[tuple[str, str]], style: str = "token") -> DataFrame:
    """path, part, xml, changed: the annotated parts with surfaces masked in annotations and authors cleared; broken parts are left as they are."""
    aliases = [(i, s, t) for i, (s, t) in enumerate(dictionary)]

    def one(automaton: Automaton, xml: str) -> tuple[str, int]:
        root = _parsed(xml)
        if root is None:
            return xml, 0
        changed, done = 0, set()
        for kind, _, e, key in list(_walk(root)):
            if kind == AUTHOR:
                if key is None:
                    e.text = ""
                else:
                    e.set(key, "")
                changed += 1
            elif id(e) not in done:
                done.add(id(e))
                text, parts, at = e.text or "", [], 0
                for start, stop, _, token in claimed([(a, b, automaton.aliases[i]) for i, places in automaton.found(text).items() for a, b in places], len(text)):
                    parts += [text[at:start], replaced(text[start:stop], token, style)]
                    at = stop
                changed += bool(parts)
                e.text = "".join([*parts, text[at:]])
        return (ElementTree.tostring(root, "unicode"), changed) if changed else (xml, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(aliases)
        for batch in batches:
            done = [one(automaton, xml) for xml in batch.column("xml").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("part"), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "part", "xml", "changed"])

    return annotation_parts(rows).mapInArrow(run, "path string, part string, xml string, changed long")
