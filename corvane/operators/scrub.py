"""Scalar clean-up of markup, brand keys, words and messages, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.patterns import unescaped
from corvane.operators.spans import substituted


def _escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _rebuilt(xml: Column, pattern: str, inner: Callable[[Column], Column]) -> Column:
    """The markup with the text of each match's second group, of three that make up the match, replaced by what ``inner`` makes of it."""
    found = lambda group: F.regexp_extract_all(xml, F.lit(pattern), F.lit(group))
    kept = F.split(xml, F.lit(pattern), -1)
    parts = F.arrays_zip(kept.alias("kept"), found(1).alias("a"), found(2).alias("b"), found(3).alias("c"))
    said = lambda x: F.when(x["b"].isNull(), F.lit("")).otherwise(F.concat(x["a"], inner(x["b"]), x["c"]))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["kept"], said(x))), "")


def scrubbed_elements(xml: Column, names: list[str], dictionary: list[tuple[str, str]], style: str = "token") -> Column:
    """The text of the named elements unescaped, with all surfaces substituted, and escaped again; all else stays."""
    pattern = rf"(?s)(<(?:\w+:)?(?:{'|'.join(names)})(?: [^>]*)?>)([^<]*)(</)"
    return _rebuilt(xml, pattern, lambda text: _escaped(substituted(unescaped(text), dictionary, style)))


def scrubbed_attributes(xml: Column, names: list[str], dictionary: list[tuple[str, str]], style: str = "token") -> Column:
    """The values of the named attributes, inside tags only, scrubbed in the same way."""
    for name in names:
        pattern = rf'(?s)(<[^<>]*?\s(?:\w+:)?{name}=")([^"<]*)(")'
        xml = _rebuilt(xml, pattern, lambda text: F.replace(_escaped(substituted(unescaped(text), dictionary, style)), F.lit('"'), F.lit("&quot;")))
    return xml


def scrubbed_links(xml: Column, dictionary: list[tuple[str, str]], style: str = "token") -> Column:
    """A relationship part with the targets of external hyperlinks scrubbed; other relations stay."""
    pattern = r'(<Relationship\b(?=[^>]*/hyperlink")(?=[^>]*TargetMode="External")[^>]*?\sTarget=")([^"]*)(")'
    return _rebuilt(xml, pattern, lambda text: F.replace(_escaped(substituted(unescaped(text), dictionary, style)), F.lit('"'), F.lit("&quot;")))


def scrubbed_metadata(xml: Column, fields: list[str], others: list[str], dictionary: list[tuple[str, str]]) -> Column:
    """Identity fields emptied whatever they hold; other fields with all surfaces substituted."""
    return scrubbed_elements(cleared_fields(xml, fields), others, dictionary)


def node_text(xml: Column) -> Column:
    """All text between tags that is not blank, joined by a space."""
    return F.array_join(F.filter(F.regexp_extract_all(xml, F.lit(r">([^<>]+)<"), F.lit(1)), lambda t: F.trim(t) != ""), " ")


def brand_key(surface: Column) -> Column:
    """Trimmed, white space collapsed, lower-cased; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(surface), r"\s+", " ")), F.lit(""))


def local_name(tag: Column) -> Column:
    """An XML name without its namespace."""
    return F.substring_index(tag, "}", -1)


def cleared_attributes(xml: Column, names: list[str]) -> Column:
    """The named attributes emptied, whatever their quotes."""
    return F.regexp_replace(xml, F.lit(rf"\b((?:\w+:)?(?:{'|'.join(names)})=)([\"']).*?\2"), F.lit("$1$2$2"))


def cleared_fields(xml: Column, names: list[str]) -> Column:
    """The text of the named elements removed."""
    return F.regexp_replace(xml, F.lit(rf"(?s)(<((?:\w+:)?(?:{'|'.join(names)}))(?: [^>]*)?>).*?(</\2>)"), F.lit("$1$3"))


def scrubbed_items(items: Column, dictionary: list[tuple[str, str]], style: str = "token") -> Column:
    """Each string of an array with all surfaces substituted; the others stay as they are."""
    return F.transform(items, lambda x: substituted(x, dictionary, style))


def normal_word(word: Column) -> Column:
    """A printed word without case and edge punctuation."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def word_matches(rows: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """key, phrase, place: where a phrase's words stand in a row, edge punctuation and a possessive on the last word aside.

    Phrases (phrase) are keyed by their first word and rows by every word, so
    this is one equi-join; the rest of the phrase is compared in place.
    """
    wanted = phrases.withColumn("words", F.filter(F.transform(F.split("phrase", r"\s+"), normal_word), lambda w: w != "")).where(F.size("words") > 0).withColumn("first", F.element_at("words", 1))
    said = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    words = rows.select(key, F.transform(said, normal_word).alias("said")).select(key, "said", F.posexplode("said").alias("place", "word"))
    # A possessive counts as its noun where the phrase ends there.
    bare = words.withColumn("first", F.explode(F.array_distinct(F.array(F.col("word"), F.regexp_replace("word", "['’]s$", "")))))
    n = F.size("words")
    found = F.slice(F.col("said"), F.col("place") + 1, n)
    last = F.element_at("words", -1)
    ends = F.element_at(found, -1)
    head = F.slice(found, 1, n - 1) == F.slice(F.col("words"), 1, n - 1)
    same = (F.size(found) == n) & head & ((ends == last) | ends.isin(F.concat(last, F.lit("'s")), F.concat(last, F.lit("’s"))))
    return bare.join(wanted, "first").where(same).select(key, "phrase", "place").distinct()


def residual_message(description: Column, matched: Column, read: Column) -> Column:
    """What to tell of an image that still shows an identity: its description, the match, the text read, or a default."""
    return F.coalesce(F.nullif(F.trim(description), F.lit("")), F.nullif(matched, F.lit("")), F.nullif(F.array_join(read, ", "), F.lit("")), F.lit("client identity in an image"))


def alt_text_entities(items: DataFrame, own: Column, known: Column, identifier: Column, merged: Column | None = None, skipped: Column | None = None, limit: float = 0.6) -> DataFrame:
    """(text) rows with entity and confidence by the first rung that holds: already merged, dictionary, first identifier at 0.9, the text itself below the limit.

    Short texts, the firm's own names and skipped terms are left out.
    """
    named = known if merged is None else F.coalesce(merged, known)
    confidence = F.when(named.isNotNull(), 1.0).when(identifier.isNotNull(), 0.9).otherwise(min(0.5, limit - 0.01))
    gone = F.coalesce(own, F.lit(False)) | (F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(False)))
    rows = items.where((F.length(F.trim("text")) >= 2) & ~gone)
    return rows.withColumn("entity", F.coalesce(named, identifier, F.trim("text"))).withColumn("confidence", confidence)
