"""Dictionaries of any size: one automaton over folded aliases finds all of them in one pass over a text.

The aliases are a table. They are taken in blocks of bounded size, each block
broadcast as rows; a task builds the block's automaton once and runs it over
its texts. What it finds is what the surface patterns find: an alias in any
case, its spaces standing for any run of white space, not between ASCII
letters or digits. Neither the plan nor its size depends on the aliases.

Folding maps every character to one character, at least all that a pattern
without regard to case calls equal, and runs of white space to one space, with
the places kept; a find is then confirmed on the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.batches import pieces, released
from corvane.operators.spans import _python_pattern, replaced

#: Bytes of aliases in one automaton: about 100 bytes of a worker's memory for each.
BLOCK_BYTES = 1 << 20
#: ASCII letters and digits, with the letters that patterns without regard to case take for i, s and k.
_BORDER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\u0130\u0131\u017f\u212a")
SPANS = "array<struct<start:int,stop:int,surface:string,ord:bigint,token:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("surface", pa.string()), ("ord", pa.int64()), ("token", pa.string())]))


class _Fold(dict):
    """A character's fold: the small letter of its capital, of either the first character if they are several."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        self[code] = ord(" ") if char.isspace() else ord(char.lower()[0].upper()[0].lower()[0])
        return self[code]


_FOLD = _Fold()


def folded(text: str) -> tuple[str, np.ndarray | None]:
    """The folded text with runs of white space as one space, and each character's place (None: its own)."""
    low = text.translate(_FOLD) if not text.isascii() else text.lower().translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " ", 28: " ", 29: " ", 30: " ", 31: " "})
    if "  " not in low:
        return low, None
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[kept].tobytes().decode("utf-32-le"), np.flatnonzero(kept)


class Automaton:
    """Finds aliases (ord, surface, token) in texts."""

    def __init__(self, aliases: list[tuple[int, str, str]]):
        self.aliases = aliases
        self.machine, by, self.odd = ahocorasick.Automaton(), {}, []
        for at, (_, surface, _) in enumerate(aliases):
            plain = surface and surface == surface.strip() and "  " not in surface and not re.search(r"[^\S ]", surface)
            if plain:
                by.setdefault(surface.translate(_FOLD), []).append(at)
            elif surface.strip():
                self.odd.append(at)  # blanks at an edge: by the pattern itself
        for key, ats in by.items():
            self.machine.add_word(key, (len(key), ats, all(aliases[at][1].isascii() for at in ats)))
        self.some = bool(by)
        if self.some:
            self.machine.make_automaton()
        self.patterns: dict[int, re.Pattern] = {}

    def _pattern(self, at: int) -> re.Pattern:
        if at not in self.patterns:
            self.patterns[at] = _python_pattern(self.aliases[at][1])
        return self.patterns[at]

    def found(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Places of each alias (by number) as its pattern finds them: from left to right, none overlapping the one before."""
        out: dict[int, list[tuple[int, int]]] = {}
        low, places = folded(text)
        end, plain = len(text), text.isascii()
        for last, (length, ats, ascii_only) in self.machine.iter(low) if self.some else ():
            first = last - length + 1
            start, stop = (first, last + 1) if places is None else (int(places[first]), int(places[last]) + 1)
            if (start and text[start - 1] in _BORDER) or (stop < end and text[stop] in _BORDER):
                continue
            sure = ascii_only and (plain or text[start:stop].isascii())
            for at in ats:
                own = out.get(at)
                if own and own[-1][1] > start:
                    continue
                if sure or ((m := self._pattern(at).match(text, start)) and m.end() == stop):
                    if own is None:
                        out[at] = [(start, stop)]
                    else:
                        own.append((start, stop))
        for at in self.odd:
            spans = [m.span() for m in self._pattern(at).finditer(text)]
            if spans:
                out[at] = spans
        return out


def claimed(found: Iterator[tuple[int, int, tuple[int, str, str]]], size: int) -> list[tuple[int, int, int, str]]:
    """Of (start, stop, alias) the spans (start, stop, ord, token) that longest-first claims leave, sorted by start; ties in order of ``ord``, then place."""
    taken, out = bytearray(size), []
    for start, stop, (order, _, token) in sorted(found, key=lambda x: (-len(x[2][1]), x[2][0], x[0])):
        if start < stop and taken.find(1, start, stop) < 0:
            taken[start:stop] = b"\1" * (stop - start)
            out.append((start, stop, order, token))
    return sorted(out)


_built: list = [None, None]


def _automaton(shared: Broadcast) -> Automaton:
    """The broadcast block's automaton, built once in a worker, which keeps the last one."""
    if _built[0] is not shared.value:
        _built[:] = shared.value, Automaton(shared.value)
    return _built[1]


_owned: list = [None, None]


def _entities(shared: Broadcast) -> tuple[Automaton, list[np.ndarray], list[pa.Array]]:
    """An automaton of the block's different surfaces; for each, its entities' numbers and its aliases' places; and columns (entity, ord, surface) by place."""
    if _owned[0] is not shared.value:
        numbers, by = {}, {}
        for at, (_, surface, entity) in enumerate(shared.value):
            by.setdefault(surface, []).append(numbers.setdefault(entity, len(numbers)) << 32 | at)
        columns = [pa.array([row[2] for row in shared.value], pa.string()), pa.array([row[0] for row in shared.value], pa.int64()), pa.array([row[1] for row in shared.value], pa.string())]
        _owned[:] = shared.value, (Automaton([(n, surface, "") for n, surface in enumerate(by)]), [np.array(x, np.int64) for x in by.values()], columns)
    return _owned[1]


def _blocks(aliases: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """The aliases (ord, surface, token) in blocks, each collected and broadcast on its own."""
    sized = aliases.where("surface is not null and trim(surface) <> ''").select(F.col("ord").cast("long").alias("ord"), "surface", "token")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("surface") + F.octet_length("token")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-2 * total // block_bytes))
    for i in range(n):
        rows = sized.where(F.pmod(F.xxhash64("surface"), F.lit(n)) == i).collect()
        yield aliases.sparkSession.sparkContext.broadcast(sorted(((r["ord"], r["surface"], r["token"] or "") for r in rows), key=lambda r: (r[0], r[1])))


def occurrences(texts: DataFrame, aliases: DataFrame, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, ord, n): how often each alias (ord, surface, token) stands in each text; null texts hold none."""
    schema = T.StructType([T.StructField("key", texts.schema[key].dataType), *T.StructType.fromDDL("ord long, n long").fields])

    def scan(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)
            for batch in (piece for whole in batches for piece in pieces(whole, "text")):
                at, order, n = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for alias, spans in automaton.found(text or "").items():
                        at.append(i)
                        order.append(automaton.aliases[alias][0])
                        n.append(len(spans))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(order, pa.int64()), pa.array(n, pa.int64())], names=["key", "ord", "n"])

        return run

    rows = texts.select(F.col(key).alias("key"), "text")
    parts = [rows.mapInArrow(released(scan(shared)), schema) for shared in _blocks(aliases, block_bytes)]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)


def sweep(docs: DataFrame, aliases: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, entity_id, surface: for each document and entity its first alias (entity_id, alias_id, surface) that the text contains.

    Aliases under three characters do not count; the result is that of
    ``detect.sweep``, which writes its aliases into the plan. A task keeps the
    first of each entity, so what is shuffled does not grow with the aliases found.
    """
    told = aliases.where(F.length(F.trim("surface")) >= 3).select(F.col("alias_id").cast("long").alias("ord"), F.trim("surface").alias("surface"), F.col("entity_id").cast("string").alias("token"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("entity string, ord long, surface string").fields])

    def scan(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, owners, columns = _entities(shared)
            for batch in (piece for whole in batches for piece in pieces(whole, "text")):
                docs, firsts = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if found := automaton.found(text or ""):
                        # An entity's number and an alias' place in one value: after sorting, the first of each entity is its first alias.
                        own = np.concatenate([owners[at] for at in found])
                        own.sort()
                        firsts.append(own[np.r_[True, own[1:] >> 32 != own[:-1] >> 32]] & 0xFFFFFFFF)
                        docs.append(np.full(len(firsts[-1]), i))
                at, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, docs))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(c.take(pa.array(at)) for c in columns)], names=["doc_id", "entity", "ord", "surface"])

        return run

    rows = docs.select("doc_id", "text")
    found = reduce(DataFrame.unionByName, [rows.mapInArrow(released(scan(shared)), schema) for shared in _blocks(told, block_bytes)])
    kind = aliases.schema["entity_id"].dataType
    return found.groupBy("doc_id", F.col("entity").cast(kind).alias("entity_id")).agg(F.min_by("surface", "ord").alias("surface"))


def _settled(texts: DataFrame, aliases: DataFrame, key: str, block_bytes: int, names: list[str], made: Callable[[str | None, list[tuple[int, int, int, str]]], tuple], kinds: list[pa.DataType], fields: str) -> DataFrame:
    """``texts`` with further columns made of each text and its claims (start, stop, ord, token), in pieces of bounded size.

    Several blocks send what they find, not the texts: the finds of a text meet
    it once, by its key, which must tell the texts apart.
    """
    blocks = list(_blocks(aliases, block_bytes))
    schema = T.StructType([*texts.schema.fields, *T.StructType.fromDDL(fields).fields])

    def added(piece: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        kept = [c for c in piece.schema.names if c != "_found"]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *columns], names=[*kept, *names])

    if len(blocks) == 1:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(blocks[0])

            def claims_of(text: str | None) -> list[tuple[int, int, int, str]]:
                found = ((a, b, automaton.aliases[at]) for at, spans in automaton.found(text or "").items() for a, b in spans)
                return claimed(found, len(text or ""))

            for batch in batches:
                for piece in pieces(batch, "text"):
                    yield added(piece, [made(text, claims_of(text)) for text in piece.column("text").to_pylist()])

        return texts.mapInArrow(released(alone), schema)

    def places(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)
            for batch in (piece for whole in batches for piece in pieces(whole, "text")):
                out = [
                    [{"start": a, "stop": b, "surface": s, "ord": o, "token": t} for at, spans in automaton.found(text or "").items() for o, s, t in [automaton.aliases[at]] for a, b in spans]
                    for text in batch.column("text").to_pylist()
                ]
                rows = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, _SPAN)], names=["key", "spans"])
                yield rows.filter(pa.array([bool(x) for x in out]))

        return run

    found_schema = T.StructType([T.StructField("key", texts.schema[key].dataType), *T.StructType.fromDDL(f"spans {SPANS}").fields])
    keyed = texts.select(F.col(key).alias("key"), "text")
    found = reduce(DataFrame.unionByName, [keyed.mapInArrow(released(places(b)), found_schema) for b in blocks])
    met = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("_found"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = zip(piece.column("text").to_pylist(), piece.column("_found").to_pylist())
                yield added(piece, [made(text, claimed(((x["start"], x["stop"], (x["ord"], x["surface"], x["token"])) for x in own or []), len(text or ""))) for text, own in rows])

    joined = texts.join(met.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").select(*texts.columns, "_found")
    return joined.mapInArrow(released(settle), schema)


def claims(texts: DataFrame, aliases: DataFrame, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts`` (key, text, …) with ``spans``: non-overlapping half-open code-point spans, longest alias first, sorted by start; null of null.

    The key must tell the texts apart. A column named spans is replaced.
    """

    def spans(text: str | None, own: list[tuple[int, int, int, str]]) -> tuple:
        return (None if text is None else [{"start": a, "stop": b, "surface": text[a:b], "ord": o, "token": t} for a, b, o, t in own],)

    return _settled(texts.drop("spans"), aliases, key, block_bytes, ["spans"], spans, [_SPAN], f"spans {SPANS}")


def masked(texts: DataFrame, aliases: DataFrame, style: str = "token", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts`` with ``masked``, the text with its claimed spans replaced, and ``n``, their number; columns of these names are replaced."""

    def splice(text: str | None, own: list[tuple[int, int, int, str]]) -> tuple:
        if text is None:
            return None, 0
        parts, at = [], 0
        for start, stop, _, token in own:
            parts += [text[at:start], replaced(text[start:stop], token, style)]
            at = stop
        return "".join([*parts, text[at:]]), len(own)

    return _settled(texts.drop("masked", "n"), aliases, key, block_bytes, ["masked", "n"], splice, [pa.string(), pa.int64()], "masked string, n long")
