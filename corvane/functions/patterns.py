"""Regular expressions for surfaces and structured identifiers, and scalar text functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The identifier patterns, public mail domains and legal suffixes that results depend on.
EMAIL = r"\b[\w.+-]+@([A-Za-z0-9-]+\.[A-Za-z0-9.-]+)\b"
URL_HOST = r"\bhttps?://([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
PHONE = r"\b(?:\+?\d[\d\s().-]{7,}\d)\b"
ACCOUNT = r"\b(?:[A-Z]{2,}-?\d{4,}|\d{6,})\b"
PUBLIC_DOMAINS = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "example.com")
LEGAL_SUFFIXES = ("Ltd", "Limited", "Inc", "LLC", "LLP", "Pvt", "Corp", "Corporation", "GmbH", "plc", "PLC", "Holdings", "Bank", "Insurance", "Capital", "Partners")

#: Java's \b, \w and \d as Python's str patterns see them.
UNICODE = "(?U)"
CONTEXT_CHARS = 40


def surface_regex(surface: str, ignore_case: bool = True) -> str:
    """A surface between ASCII non-alphanumerics; its spaces match any run of white space."""
    body = r"\s+".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", part) if part.isascii() else rf"\Q{part}\E" for part in surface.split(" "))
    return ("(?iu)" if ignore_case else "") + rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])"


def alike(value: Column) -> Column:
    """The value with white space collapsed and case folded both ways, so that what a pattern calls equal is equal."""
    return F.upper(F.lower(F.replace(F.regexp_replace(value, r"\s+", " "), F.lit("İ"), F.lit("i"))))


def any_surface_regex(surfaces: list[str]) -> str:
    """One pattern that finds any of the surfaces; it matches nothing if there are none."""
    found = [surface_regex(s.strip(), False) for s in surfaces if s.strip()]
    return "(?iu)(?:" + "|".join(found) + ")" if found else r"(?!)"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of the pattern, in order."""
    return F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(group))


def identifiers(text: Column) -> Column:
    """array<struct<surface, entity_type>> in emission order: mail domains, URL hosts, phones, accounts."""

    def typed(found: Column, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("surface"), F.lit(kind).alias("entity_type")))

    def hosts(pattern: str) -> Column:
        return F.filter(F.transform(matches(text, pattern, 1), F.lower), lambda x: ~x.isin(*PUBLIC_DOMAINS))

    return F.concat(typed(hosts(EMAIL), "CLIENT_EMAIL_DOMAIN"), typed(hosts(URL_HOST), "CLIENT_EMAIL_DOMAIN"), *(typed(F.transform(matches(text, p), lambda x: F.trim(x)), "CLIENT_CONTRACT_ID") for p in (PHONE, ACCOUNT)))


def context_window(text: Column, surface: Column) -> Column:
    """Up to 40 characters on both sides of the surface's first place (any case), line feeds as spaces."""
    at = F.instr(F.lower(text), F.lower(surface))
    start = F.greatest(at - CONTEXT_CHARS, F.lit(1))
    window = F.substring(text, start, at + F.length(surface) + CONTEXT_CHARS - start)
    return F.when(at > 0, F.replace(window, F.lit("\n"), F.lit(" ")))


def normalized_ascii(value: Column) -> Column:
    """The dictionary key of an ASCII value: trimmed and lower-cased, then punctuation goes and white space collapses."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(value)), r"[^\w@.\s-]", ""), r"\s+", " ")


@F.pandas_udf(T.StringType())
def normalized(values: pd.Series) -> pd.Series:
    """The dictionary key of any value; accents fold first. Spark has no Unicode normal forms, hence Arrow batches."""

    def key(value: str | None) -> str | None:
        if value is None:
            return None
        folded = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^\w@.\s-]", "", folded.lower().strip()))

    return values.map(key)


def _normalized_plain(value: Column) -> Column:
    """The dictionary key of an ASCII value, as Python makes it."""
    blank = r"[\s\x1c-\x1f]"  # what Python calls white space
    edges = F.regexp_replace(F.lower(value), rf"\A{blank}+|{blank}+\z", "")
    said = F.regexp_replace(F.regexp_replace(edges, r"[^a-z0-9_@.\s\x1c-\x1f-]", ""), rf"{blank}+", " ")
    return F.when(value.rlike(r"[^A-Za-z0-9_@.-]"), said).otherwise(F.lower(value))


def with_key(rows: DataFrame, column: str = "surface") -> DataFrame:
    """The rows with ``key``, the dictionary key of a column; only rows whose value is not ASCII are sent to Python."""
    odd = F.coalesce(F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return rows.where(~odd).withColumn("key", _normalized_plain(F.col(column))).unionByName(rows.where(odd).withColumn("key", normalized(F.col(column))))


def unescaped(text: Column) -> Column:
    """XML's named entities as characters."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def boundary_regex(token: str) -> str:
    """A token, up to three capitalised words and a legal suffix: what is left of a name masked in part."""
    return rf"\Q{token}\E\s*((?:[A-Z][A-Za-z&]*\s+){{0,3}}(?:{'|'.join(LEGAL_SUFFIXES)})\.?)(?!\w)"


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; null if either is not one."""

    def half(h: Column, at: int) -> Column:
        return F.conv(F.substring(h, at, 8), 16, 10).cast("long")

    valid = left.rlike("^[0-9a-fA-F]{16}$") & right.rlike("^[0-9a-fA-F]{16}$")
    return F.when(valid, F.bit_count(half(left, 1).bitwiseXOR(half(right, 1))) + F.bit_count(half(left, 9).bitwiseXOR(half(right, 9))))


def sign_hash(embedding: Column) -> Column:
    """16 hexadecimal digits of the signs of the first 64 values, the first value highest."""
    bits = F.array_join(F.transform(F.slice(embedding, 1, 64), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(bits, at, 32), 2, 16), 8, "0") for at in (1, 33))))
