"""Chunks, candidate strings, dictionary matches, merging and gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.patterns import alike, any_surface_regex, context_window, identifiers, surface_regex

CHUNK_LINES = 8
SOURCE_PRIORITY = ("dictionary", "model", "image", "alt_text")


def chunks(docs: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """doc_id, chunk_id, text: ``size`` non-blank lines each, joined by a blank line, in document order; no shuffle."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(lines, i * size + 1, size), "\n\n"))
    return docs.where(F.size(lines) > 0).select("doc_id", F.posexplode(cut).alias("chunk_id", "text"))


def chunk_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Chunks start to end of each document, end held to the last one; ids count from 0."""
    return rows.where(F.col("chunk_id").between(max(start, 0), end))


def candidate_rows(rows: DataFrame) -> DataFrame:
    """One row per emitted identifier: doc_id, chunk_id, ord, surface, entity_type, text."""
    found = F.posexplode(identifiers(F.col("text"))).alias("ord", "x")
    return rows.select("doc_id", "chunk_id", "text", found).select("doc_id", "chunk_id", "ord", "x.surface", "x.entity_type", "text")


def candidates(rows: DataFrame) -> DataFrame:
    """Per document and lower-cased surface: first surface and type, occurrences, the first two contexts.

    The context is cut before the shuffle, so no chunk text is moved.
    """
    order = F.struct("chunk_id", "ord")
    emitted = candidate_rows(rows).select("doc_id", "surface", "entity_type", order.alias("at"), F.lower("surface").alias("key"), context_window(F.col("text"), F.col("surface")).alias("context"))
    firsts = F.slice(F.array_sort(F.collect_list(F.when(F.col("context").isNotNull(), F.struct("at", "context")))), 1, 2)
    return emitted.groupBy("doc_id", "key").agg(F.min_by("surface", "at").alias("surface"), F.min_by("entity_type", "at").alias("entity_type"), F.count(F.lit(1)).alias("occurrences"), F.transform(firsts, lambda x: x["context"]).alias("contexts"))


def own_firm(surface: Column, names: tuple[str, ...]) -> Column:
    """Whether the surface names the firm itself, as a whole word."""
    return surface.rlike(any_surface_regex(list(names)))


def sweep(docs: DataFrame, aliases: list[tuple[int, int, str]], own_names: tuple[str, ...]) -> DataFrame:
    """doc_id, entity_id, surface: for each document and entity the first alias that its text contains.

    ``aliases``: (entity, alias order, surface) of approved entities. The
    patterns are tested in one pass over the text, without a join: each entity
    is one chain of alternatives. Aliases under three characters and the firm's
    own names do not count.
    """
    import re

    own = re.compile("|".join(rf"(?<![A-Za-z0-9]){re.escape(n)}(?![A-Za-z0-9])" for n in own_names) or r"(?!)", re.IGNORECASE)
    by_entity: dict[int, list[str]] = {}
    for entity, _, surface in sorted(aliases):
        if len(surface.strip()) >= 3 and not own.search(surface):
            by_entity.setdefault(entity, []).append(surface.strip())
    hits = []
    for entity, surfaces in by_entity.items():
        first = F.coalesce(*[F.when(F.col("text").rlike(surface_regex(s)), F.lit(s)) for s in surfaces])
        hits.append(F.struct(F.lit(entity).alias("entity_id"), first.alias("surface")))
    if not hits:
        return docs.select("doc_id", F.lit(0).alias("entity_id"), F.lit("").alias("surface")).limit(0)
    found = F.filter(F.array(*hits), lambda x: x["surface"].isNotNull())
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.entity_id", "x.surface")


def sweep_indexed(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """The same for large dictionaries: (entity_id, alias_id, surface) as a table, by an inverted index.

    Each alias is keyed by its longest ASCII alphanumeric token, each text by
    its distinct tokens; the equi-join loses nothing, as alias edges are token
    boundaries, and the pattern then confirms. Aliases without such a token are
    keyed by their first two characters, texts by all their distinct pairs of
    characters; that index is built only if there are such aliases.
    """
    tokens = F.filter(F.split(F.lower("surface"), "[^a-z0-9]+"), lambda t: t != "")
    longest = F.try_element_at(F.array_sort(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), F.lit(-1))["t"]
    keyed = aliases.where(F.length(F.trim("surface")) >= 3).select("entity_id", "alias_id", F.trim("surface").alias("surface")).withColumn("token", longest)
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("token")).where("token <> ''")
    pairs = words.join(keyed.where("token is not null"), "token")
    odd = keyed.where("token is null").withColumn("token", F.substring(alike(F.col("surface")), 1, 2))
    if not odd.isEmpty():
        doubles = F.array_distinct(F.regexp_extract_all(alike(F.col("text")), F.lit("(?s)(?=([^A-Z0-9].))"), F.lit(1)))
        pairs = pairs.unionByName(docs.select("doc_id", F.explode(doubles).alias("token")).join(odd, "token"))
    quoted = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])\Q"), F.replace("surface", F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    # A text meets all its candidates once, however many they are.
    candidate = F.struct("entity_id", "alias_id", "surface", quoted.alias("pattern"))
    own = pairs.distinct().groupBy("doc_id").agg(F.collect_list(candidate).alias("candidates"))
    said = own.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.filter("candidates", lambda c: F.regexp_like("text", c["pattern"]))).alias("c")).select("doc_id", "c.*")
    return said.groupBy("doc_id", "entity_id").agg(F.min_by("surface", "alias_id").alias("surface"))


def occurrence_counts(docs: DataFrame, surfaces: list[str]) -> DataFrame:
    """doc_id, surface, occurrences for every surface that occurs; overlaps between surfaces are ignored."""
    counts = F.array(*[F.struct(F.lit(s).alias("surface"), F.regexp_count("text", F.lit(surface_regex(s))).cast("long").alias("occurrences")) for s in surfaces])
    return docs.select("doc_id", F.explode(F.filter(counts, lambda x: x["occurrences"] > 0)).alias("x")).select("doc_id", "x.*")


def merged_entities(sources: DataFrame) -> DataFrame:
    """Of (doc_id, key, source, …) the row of the first source by priority for each document and key."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCE_PRIORITY]), F.col("source"))
    first = Window.partitionBy("doc_id", "key").orderBy(rank, "surface")
    return sources.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def gated(scored: DataFrame, thresholds: DataFrame, default: float = 0.6) -> DataFrame:
    """Adds threshold and passes: known entities always do, others from their type's threshold on."""
    joined = scored.join(thresholds, "entity_type", "left")
    limit = F.coalesce("threshold", F.lit(default))
    return joined.withColumn("threshold", limit).withColumn("passes", F.col("known") | (F.col("confidence") >= limit))


def capped_confidence(surface: Column, confidence: Column, threshold: float = 0.6, short: int = 4) -> Column:
    """Short strings read from images stay just under the threshold."""
    return F.when(F.length(surface) < short, F.least(confidence, F.lit(threshold - 0.01))).otherwise(confidence)
