"""Queries with dictionaries that are tables: every word and pair of words of the benchmark is an alias of its item."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import automaton
from corvane.plans.detection import _DOUBLED
from corvane.sources.tables import table

WORD, PAIR = "[A-Za-z]{4,}", "[A-Za-z]{3,} [A-Za-z]{3,}"


def _aliases(spark, folder):
    """(entity_id, alias_id, surface): the pairs and then the words of each item, in order."""
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = table(spark, folder, "benchmark").select("item_id", F.posexplode(F.concat(every(PAIR), every(WORD))).alias("place", "surface"))
    return rows.select(F.col("item_id").alias("entity_id"), (F.col("item_id") * 10000 + F.col("place")).alias("alias_id"), "surface")


def _dictionary(spark, folder):
    """(ord, surface, token): each spelling once, its token that of its first item."""
    first = _aliases(spark, folder).groupBy("surface").agg(F.min(F.struct("alias_id", "entity_id")).alias("x"))
    return first.select(F.col("x.alias_id").alias("ord"), "surface", F.format_string("[ITEM_%d]", "x.entity_id").alias("token"))


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def alias_sweep(spark, folder):
    """The first alias of each item in each document."""
    return automaton.sweep(_docs(spark, folder), _aliases(spark, folder))


def alias_occurrences(spark, folder):
    """How many aliases stand in each document, and how often."""
    rows = automaton.occurrences(_docs(spark, folder), _dictionary(spark, folder))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("aliases"), F.sum("n").alias("n"))


def alias_masks(spark, folder):
    """Every document with its claimed aliases masked, longest first."""
    return automaton.masked(_docs(spark, folder), _dictionary(spark, folder)).select("doc_id", "masked", "n")


_ALIASES = (
    f"(SELECT item_id AS entity_id, item_id * 10000 + generate_subscripts(l, 1) - 1 AS alias_id, unnest(l) AS surface FROM (SELECT item_id, "
    f"list_concat(regexp_extract_all(text, '{PAIR}'), regexp_extract_all(text, '{WORD}')) AS l FROM benchmark))"
)
# Pairs that hold the letters at all are few; the pattern then decides.
_MET = """(SELECT doc_id, doubled, s.surface, '(?i)(^|[^A-Za-z0-9])' || replace(s.surface, ' ', '\\s+') || '([^A-Za-z0-9]|$)' AS pattern FROM (SELECT doc_id, text, @DOUBLED@ AS doubled, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS low FROM documents) d JOIN (SELECT DISTINCT surface FROM @ALIASES@ a) s ON contains(low, lower(s.surface)))""".replace("@DOUBLED@", _DOUBLED).replace("@ALIASES@", _ALIASES)
ORACLE = {
    "alias_sweep": (
        f"SELECT doc_id, entity_id, arg_min(a.surface, alias_id) AS surface FROM (SELECT doc_id, surface FROM {_MET} m WHERE regexp_matches(doubled, pattern)) "
        f"h JOIN {_ALIASES} a USING (surface) GROUP BY doc_id, entity_id"
    ),
    "alias_occurrences": (
        f"SELECT doc_id, count(*)::BIGINT AS aliases, sum(n)::BIGINT AS n FROM (SELECT doc_id, len(regexp_extract_all(doubled, pattern)) AS n FROM {_MET} m) "
        f"WHERE n > 0 GROUP BY doc_id"
    ),
}
QUERIES = {name: globals()[name] for name in [*ORACLE, "alias_masks"]}
