"""Match offsets, longest-first claims and splicing.

The claim goes over the surfaces longest first (ties in dictionary order), and
takes every match that does not overlap an earlier claim. Spark's expressions
have no match offsets, and arrays that grow match by match cost the square of
a text's matches; so one Arrow pass per batch searches each text once for each
surface and marks what is claimed, in time linear in the text. A batch is taken
in pieces of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.batches import mapped
from corvane.functions.patterns import surface_regex

SPAN = "array<struct<start:int,stop:int,surface:string,token:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("surface", pa.string()), ("token", pa.string())]))
Claim = Callable[[str], list[tuple[int, int, str]]]


def _python_pattern(surface: str) -> re.Pattern:
    """A surface between ASCII non-alphanumerics; its spaces match any run of white space."""
    body = r"\s+".join(re.escape(part) for part in surface.split(" "))
    return re.compile(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", re.IGNORECASE)


def _claimer(dictionary: Sequence[tuple[str, str]]) -> Claim:
    """Finds (start, stop, token) of all claimed spans of a text, sorted by start."""
    ranked = [(_python_pattern(s), t) for s, t in sorted(dictionary, key=lambda row: -len(row[0]))]

    def claim(text: str) -> list[tuple[int, int, str]]:
        taken, out = bytearray(len(text)), []
        for pattern, token in ranked:
            for found in pattern.finditer(text):
                start, stop = found.span()
                if start < stop and taken.find(1, start, stop) < 0:
                    taken[start:stop] = b"\1" * (stop - start)
                    out.append((start, stop, token))
        return sorted(out)

    return claim


def replaced(surface: str, token: str, style: str | None) -> str:
    """What stands for a masked surface: its token, a bar of at least three blocks, or nothing; unknown styles are tokens."""
    return {"remove": "", "black": "█" * max(len(surface), 3)}.get(style, token)


def _spliced(text: str, spans: list[tuple[int, int, str]], style: str | None) -> str:
    parts, at = [], 0
    for start, stop, token in spans:
        parts += [text[at:start], replaced(text[start:stop], token, style)]
        at = stop
    return "".join([*parts, text[at:]])


def claimed_spans(text: Column, dictionary: Sequence[tuple[str, str]]) -> Column:
    """array<struct<start, stop, surface, token>>: non-overlapping half-open code-point spans, longest surface first, sorted by start; null of null."""
    claim = _claimer(dictionary)

    def spans(texts: list) -> list:
        return [None if t is None else [{"start": a, "stop": b, "surface": t[a:b], "token": token} for a, b, token in claim(t)] for t in texts]

    def run(texts: pa.Array) -> pa.Array:
        return mapped(_SPANS, spans, texts)

    return F.arrow_udf(run, SPAN)(text)


def masked(text: Column, dictionary: Sequence[tuple[str, str]], style: str | Column = "token") -> Column:
    """Longest-first masked text."""
    claim = _claimer(dictionary)

    def run(texts: pa.Array, styles: pa.Array) -> pa.Array:
        return mapped(pa.string(), lambda *rows: [None if t is None else _spliced(t, claim(t), s) for t, s in zip(*rows)], texts, styles)

    return F.arrow_udf(run, "string")(text, F.lit(style) if isinstance(style, str) else style)


def masked_and_counted(text: Column, dictionary: Sequence[tuple[str, str]], style: str = "token") -> Column:
    """struct<masked, n>: the masked text and the number of its spans, found in one pass."""
    claim = _claimer(dictionary)

    def found(texts: list) -> list:
        return [{"masked": None, "n": 0} if t is None else {"masked": _spliced(t, spans := claim(t), style), "n": len(spans)} for t in texts]

    def run(texts: pa.Array) -> pa.Array:
        return mapped(pa.struct([("masked", pa.string()), ("n", pa.int64())]), found, texts)

    return F.arrow_udf(run, "masked string, n long")(text)


def masked_pieces(pieces: Column, dictionary: Sequence[tuple[str, str]], style: str = "token") -> Column:
    """Masked runs of one paragraph: a span's replacement goes to the first run it touches, the others lose their share.

    ``pieces``: array of the runs' texts; matches are found in the joined text.
    """
    claim = _claimer(dictionary)

    def one(runs: list[str]) -> list[str]:
        text = "".join(r or "" for r in runs)
        spans, out, at, i = claim(text), [], 0, 0
        for run in (r or "" for r in runs):
            end, parts, place = at + len(run), [], at
            while i < len(spans) and spans[i][0] < end:
                start, stop, token = spans[i]
                if start >= at:
                    parts += [text[place:start], replaced(text[start:stop], token, style)]
                place = min(stop, end)
                if stop > end:
                    break
                i += 1
            out.append("".join([*parts, text[place:end]]))
            at = end
        return out

    def run(rows: pa.Array) -> pa.Array:
        return mapped(pa.list_(pa.string()), lambda own: [None if runs is None else one(runs) for runs in own], rows)

    return F.arrow_udf(run, "array<string>")(pieces)


def substituted(text: Column, dictionary: Sequence[tuple[str, str]], style: str = "token") -> Column:
    """Successive replacement, longest first: a later surface may match inside an earlier token."""
    for surface, token in sorted(dictionary, key=lambda row: -len(row[0])):
        bar = "█" * max(len(surface), 3)
        text = F.regexp_replace(text, F.lit(surface_regex(surface)), F.lit({"remove": "", "black": bar}.get(style, token).replace("\\", r"\\").replace("$", r"\$")))
    return text
