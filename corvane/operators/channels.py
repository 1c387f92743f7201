"""Channels of a document, what they still expose, and verdicts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.patterns import boundary_regex, surface_regex

# Package parts that a scan covers, path fragments that suggest an identity, and parts known to be safe.
COVERED = (
    r"^docProps/(core|app|custom)\.xml$", r"^ppt/comments/comment\d*\.xml$", r"^ppt/comments/modernComment_.*\.xml$", r"^ppt/commentAuthors\.xml$", r"^ppt/authors\.xml$", r"^word/comments\.xml$", r"^word/people\.xml$", r"^word/document\.xml$", r"^word/(header|footer)\d*\.xml$",
    r"^xl/comments\d*\.xml$", r"^xl/comments/comment\d*\.xml$", r"^xl/threadedComments/threadedComment\d*\.xml$", r"^xl/persons/person\.xml$", r"^ppt/(slides|slideLayouts|slideMasters|notesSlides)/[^/]+\.xml$", r"^xl/drawings/drawing\d*\.xml$",
)
IDENTITY_WORDS = ("author", "person", "people", "creator", "owner", "comment", "contributor", "editor", "reviewer", "annotator", "presence")
SAFE = (r"^ppt/tags/tag\d*\.xml$", r"^\[Content_Types\]\.xml$")

HREF, COMMENT, TITLE, META, TAG = r'href="([^"]*)"', r"(?s)<!--(.*?)-->", r"(?s)<title>(.*?)</title>", r'<meta [^>]*content="([^"]*)"', r"(?s)<!--.*?-->|<[^>]*>"


def page_channels(pages: DataFrame) -> DataFrame:
    """page_id, channel, item, text: hyperlinks, comments, metadata and body text of HTML pages; no shuffle."""

    def items(channel: str, found: Column) -> Column:
        return F.transform(found, lambda x, i: F.struct(F.lit(channel).alias("channel"), i.alias("item"), x.alias("text")))

    def every(pattern: str) -> Column:
        return F.regexp_extract_all("html", F.lit(pattern), F.lit(1))

    rows = F.concat(items("hyperlinks", every(HREF)), items("comments", every(COMMENT)), items("metadata", F.concat(every(TITLE), every(META))), items("text", F.array(F.regexp_replace("html", TAG, " "))))
    return pages.select("page_id", F.explode(rows).alias("x")).select("page_id", "x.*")


def residual(channel_text: DataFrame, surfaces: list[str]) -> DataFrame:
    """The rows, once per surface that still stands in them."""
    found = F.array(*[F.when(F.col("text").rlike(surface_regex(s)), F.lit(s)) for s in surfaces]) if surfaces else F.expr("cast(array() as array<string>)")
    return channel_text.withColumn("surface", F.explode(F.array_compact(found)))


def verdicts(channel_text: DataFrame, surfaces: list[str], key: str = "page_id") -> DataFrame:
    """key, channel, clean: whether no surface stands in any item; an empty surface list leaves every channel clean."""
    hit = F.lit(False)
    for s in surfaces:
        hit = hit | F.coalesce(F.col("text").rlike(surface_regex(s)), F.lit(False))
    return channel_text.groupBy(key, "channel").agg(F.bool_and(~hit).alias("clean"))


def all_clean(channel_verdicts: DataFrame, key: str = "page_id") -> DataFrame:
    """key, clean: clean on every channel that was evaluated; null if none was."""
    return channel_verdicts.groupBy(key).agg(F.bool_and("clean").alias("clean"))


def part_warnings(parts: DataFrame) -> DataFrame:
    """Package parts whose path suggests an identity and that no scan claims."""
    suspect = F.lower("part").rlike("|".join(IDENTITY_WORDS))
    return parts.where(suspect & ~F.col("part").rlike("|".join(COVERED)) & ~F.col("part").rlike("|".join(SAFE)))


def boundary_leaks(texts: DataFrame, tokens: list[str], key: str = "doc_id") -> DataFrame:
    """key, token, leaked: what follows a token up to a legal suffix; once per token and lower-cased leak."""
    ordered = sorted(set(tokens), key=len, reverse=True)
    if not ordered:
        return texts.select(key, F.lit("").alias("token"), F.lit("").alias("leaked")).limit(0)

    def leaks(n: int, token: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(boundary_regex(token)), F.lit(1))
        return F.transform(found, lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.lit(token).alias("token"), F.trim(x).alias("leaked")))

    found = F.concat(*[leaks(n, token) for n, token in enumerate(ordered)])
    rows = texts.select(key, F.explode(found).alias("x")).select(key, "x.*")
    return rows.groupBy(key, "token", F.lower("leaked").alias("k")).agg(F.min_by("leaked", F.struct("n", "i")).alias("leaked")).drop("k")


def completeness(masked: Column, residuals: Column) -> Column:
    """100 * masked / (masked + residuals), one decimal, half to even; 100 if both are 0."""
    both = masked + residuals
    return F.when(both == 0, F.lit(100.0)).otherwise(F.bround(100.0 * masked / both, 1))
