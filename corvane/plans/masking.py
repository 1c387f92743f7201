"""Queries on masking and on what is left exposed."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.patterns import surface_regex
from corvane.operators import channels, spans
from corvane.plans.detection import _DOUBLED, _found
from corvane.plans.fixtures import approved, literal, values
from corvane.sources.tables import table

LEFT = ["the", "of the", "ing", "is"]
#: (surface, token) that a second look adds.
ADDED = [("is", "[CLIENT_5]")]
LEAKY = ["anon", "the", "of the"]
PLANTED = [(0, "[CLIENT_1] Turbine Ltd. and more"), (1, "[CLIENT_2] Big Power Holdings, [CLIENT_2] BIG Power Holdings"), (2, "nothing [CLIENT_1] here"), (3, "[CLIENT_1] Capital"), (4, "[CLIENT_2] one Ltd")]


def _docs(spark, folder):
    return table(spark, folder, "documents").where("text is not null")


def mask_spans(spark, folder):
    rows = _docs(spark, folder).select("doc_id", F.explode(spans.claimed_spans(F.col("text"), approved())).alias("x"))
    return rows.groupBy("doc_id", F.col("x.token").alias("token")).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("x.stop") - F.col("x.start")).alias("n_chars"))


def _masked(style):
    def query(spark, folder):
        return _docs(spark, folder).select("doc_id", spans.masked(F.col("text"), approved(), style).alias("masked"))

    return query


mask_token_text, mask_black, mask_remove = _masked("token"), _masked("black"), _masked("remove")


def mask_sequential(spark, folder):
    rows = channels.page_channels(table(spark, folder, "pages")).where("channel in ('hyperlinks', 'metadata')")
    return rows.select("page_id", "channel", F.col("item").cast("long").alias("item"), spans.substituted(F.col("text"), approved()).alias("masked"))


def occurrence_rows(spark, folder):
    """One row per masked span with its place and entity; a match that wraps a line finds no entity."""
    entity = literal(spark, "dictionary").where("status = 'approved'").groupBy(F.lower("surface").alias("key")).agg(F.min("entity_id").alias("entity_id"))
    rows = _docs(spark, folder).select("doc_id", F.explode(spans.claimed_spans(F.col("text"), approved())).alias("x")).select("doc_id", "x.start", "x.stop", "x.surface", F.lower("x.surface").alias("key"))
    return rows.join(entity, "key", "left").select("doc_id", "start", "stop", "surface", "entity_id")


def entity_occurrences(spark, folder):
    return occurrence_rows(spark, folder).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def residual_text(spark, folder):
    masked = mask_token_text(spark, folder).select("doc_id", F.col("masked").alias("text"))
    return channels.residual(masked, LEFT).select("doc_id", "surface")


def _residual(channel):
    def query(spark, folder):
        rows = channels.page_channels(table(spark, folder, "pages")).where(F.col("channel") == channel)
        return channels.residual(rows, LEAKY).select("page_id", F.col("item").cast("long").alias("item"), "surface")

    return query


residual_hyperlinks, residual_comments, residual_metadata = _residual("hyperlinks"), _residual("comments"), _residual("metadata")


def unconditional_identity(spark, folder):
    rows = channels.page_channels(table(spark, folder, "pages")).where("channel = 'metadata' and trim(text) <> ''")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_fields"))


def channel_coverage(spark, folder):
    """Each page is a part, of one of the listed paths in a package of its own."""
    paths = literal(spark, "parts").agg(F.sort_array(F.collect_list("part")).alias("paths"))
    pages = table(spark, folder, "pages").join(F.broadcast(paths)).select("page_id", F.element_at("paths", (F.col("page_id") % F.size("paths") + 1).cast("int")).alias("part"))
    return channels.part_warnings(pages)


def channel_verdict(spark, folder):
    rows = channels.verdicts(channels.page_channels(table(spark, folder, "pages")), LEAKY)
    return rows.groupBy("page_id").agg(F.bool_and("clean").alias("clean"), F.count_if(~F.col("clean")).alias("n_dirty"))


def boundary_leaks(spark, folder):
    """Every document with one of the planted lines at its end."""
    lines = F.element_at(F.array(*[F.lit(line) for _, line in PLANTED]), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    rows = table(spark, folder, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), lines).alias("text"))
    return channels.boundary_leaks(rows, ["[CLIENT_1]", "[CLIENT_2]"])


def _scored(spark, folder, dictionary):
    """Masked spans and residual surfaces of each document, found in one pass without a shuffle."""
    rows = _docs(spark, folder).select("doc_id", spans.masked_and_counted(F.col("text"), dictionary).alias("x"))
    left = sum((F.col("x.masked").rlike(surface_regex(s)).cast("long") for s in LEFT), F.lit(0))
    counted = rows.select("doc_id", F.col("x.n").alias("masked"), left.cast("long").alias("residual"))
    return counted.withColumn("score", channels.completeness(F.col("masked"), F.col("residual")))


def completeness_score(spark, folder):
    return _scored(spark, folder, approved())


def revalidation(spark, folder):
    """Masked, counted and scored again with the names that a second look has added."""
    return _scored(spark, folder, approved() + ADDED)


def residual_union(spark, folder):
    """Leaks at token boundaries and what a second look finds, as a bag."""
    leaks = boundary_leaks(spark, folder).select("doc_id", F.col("leaked").alias("surface"))
    return leaks.unionByName(residual_text(spark, folder))


def verify_corpus(spark, folder):
    """Texts and alternative texts that are verified together."""
    rows = channels.page_channels(table(spark, folder, "pages"))
    both = rows.where("channel = 'text'").unionByName(rows.where("channel = 'metadata'"))
    return both.groupBy("page_id").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def flagship(spark, folder):
    """Per document: candidates found, surfaces in the dictionary, spans masked, what is left, and the masked text."""
    from corvane.plans import detection

    found = detection.pii_candidates(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidates"))
    known = detection.dictionary_sweep(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("known"))
    report = completeness_score(spark, folder).join(found, "doc_id", "left").join(known, "doc_id", "left").na.fill(0, ["candidates", "known"])
    return report.join(mask_token_text(spark, folder), "doc_id")


def _replaced(text: str, style, dictionary=None) -> str:
    """Nested, never crossing surfaces: successive replacement, twice each as neighbours share a delimiter."""
    for surface, token in sorted(dictionary or approved(), key=lambda x: -len(x[0])):
        body = r"\s+".join(surface.split(" "))
        to = style(surface, token)
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^A-Za-z0-9]){body}([^A-Za-z0-9]|$)', '\\1{to}\\2', 'gi')"
    return text


def _spans(dictionary) -> str:
    """Spans of nested surfaces: the longer ones are blanked before the shorter ones are counted."""
    counted, text = [], "text"
    for surface, token in sorted(dictionary, key=lambda x: -len(x[0])):
        body = r"\s+".join(surface.split(" "))
        counted.append(f"SELECT doc_id, '{token}' AS token, regexp_extract_all(regexp_replace({text}, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?i)(?:^|[^A-Za-z0-9])(' || '{body}' || ')(?:[^A-Za-z0-9]|$)', 1) AS m FROM documents")
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^A-Za-z0-9]){body}([^A-Za-z0-9]|$)', '\\1##\\2', 'gi')"
    return "(" + " UNION ALL ".join(counted) + ")"


_PAGE = f"""(SELECT page_id, 'hyperlinks' AS channel, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS item FROM (SELECT page_id, regexp_extract_all(html, '{channels.HREF}', 1) AS l FROM pages)
UNION ALL SELECT page_id, 'comments', unnest(l), generate_subscripts(l, 1) - 1 FROM (SELECT page_id, regexp_extract_all(html, '{channels.COMMENT}', 1) AS l FROM pages)
UNION ALL SELECT page_id, 'metadata', unnest(l), generate_subscripts(l, 1) - 1 FROM (SELECT page_id, list_concat(regexp_extract_all(html, '{channels.TITLE}', 1), regexp_extract_all(html, '{channels.META}', 1)) AS l FROM pages)
UNION ALL SELECT page_id, 'text', regexp_replace(html, '{channels.TAG}', ' ', 'g'), 0 FROM pages)"""


def _left(source: str, columns: str, surfaces: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{s}' AS surface FROM {source} q WHERE regexp_matches({_DOUBLED}, '{_found(s)}')" for s in surfaces)


def _hits(surfaces: list[str]) -> str:
    return " OR ".join(f"regexp_matches({_DOUBLED}, '{_found(s)}')" for s in surfaces)


_MASKED = _replaced("text", lambda s, t: t)
_SPANS = _spans(approved())


def _score(dictionary) -> str:
    masked = _replaced("text", lambda s, t: t, dictionary)
    left = _left(f"(SELECT doc_id, {masked} AS text FROM documents)", "doc_id", LEFT)
    return (
        f"SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS masked, coalesce(r.n, 0)::BIGINT AS residual, CASE WHEN coalesce(m.n, 0) + coalesce(r.n, 0) "
        f"= 0 THEN 100.0::DOUBLE ELSE round_even(100.0::DOUBLE * coalesce(m.n, 0) / (coalesce(m.n, 0) + coalesce(r.n, 0)), 1)::DOUBLE END AS score "
        f"FROM documents d LEFT JOIN (SELECT doc_id, sum(len(m)) AS n FROM {_spans(dictionary)} s GROUP BY ALL) m USING (doc_id) LEFT JOIN (SELECT doc_id, "
        f"count(*) AS n FROM ({left}) GROUP BY ALL) r USING (doc_id) WHERE d.text IS NOT NULL"
    )


_DOC_RESIDUAL = _left(f"(SELECT doc_id, {_MASKED} AS text FROM documents)", "doc_id", LEFT)

ORACLE = {
    # Doubling widens only the white space inside two-word surfaces: one character for every space between.
    "mask_spans": (
        f"SELECT doc_id, token, sum(len(m))::BIGINT AS n_spans, sum(list_sum(list_transform(m, lambda x: length(regexp_replace(x, '([^A-Za-z0-9])[^A-Za-z0-9]', "
        f"'\\1', 'g')))))::BIGINT AS n_chars FROM {_SPANS} s WHERE len(m) > 0 GROUP BY ALL"
    ),
    "mask_token_text": f"SELECT doc_id, {_MASKED} AS masked FROM documents",
    "mask_remove": f"SELECT doc_id, replace({_replaced('text', lambda s, t: '##@##')}, '##@##', '') AS masked FROM documents",
    "mask_black": f"SELECT doc_id, {_replaced('text', lambda s, t: '█' * len(s))} AS masked FROM documents",
    "entity_occurrences": (
        f"SELECT entity_id, count(*)::BIGINT AS n FROM (SELECT lower(regexp_replace(unnest(m), '([^A-Za-z0-9])[^A-Za-z0-9]', '\\1', 'g')) AS key "
        f"FROM {_SPANS} s) x LEFT JOIN (SELECT lower(surface) AS key, min(entity_id) AS entity_id FROM {values('dictionary')} d WHERE status = 'approved' "
        f"GROUP BY ALL) e USING (key) GROUP BY ALL"
    ),
    "mask_sequential": f"SELECT page_id, channel, item::BIGINT AS item, {_MASKED} AS masked FROM {_PAGE} p WHERE channel IN ('hyperlinks', 'metadata')",
    "residual_text": _DOC_RESIDUAL,
    "unconditional_identity": f"SELECT page_id, count(*)::BIGINT AS n_fields FROM {_PAGE} p WHERE channel = 'metadata' AND trim(text, ' ') <> '' GROUP BY ALL",
    "channel_coverage": "SELECT page_id, part FROM (SELECT page_id, l[page_id % len(l) + 1] AS part FROM pages, (SELECT list(part ORDER BY part) AS l FROM " + values("parts") + " x)) p WHERE regexp_matches(lower(part), '" + "|".join(channels.IDENTITY_WORDS) + "') AND NOT regexp_matches(part, '" + "|".join(channels.COVERED + channels.SAFE) + "')",
    "channel_verdict": (
        f"SELECT page_id, bool_and(NOT hit) AS clean, count(DISTINCT CASE WHEN hit THEN channel END)::BIGINT AS n_dirty FROM (SELECT page_id, channel, "
        f"({_hits(LEAKY)}) AS hit FROM {_PAGE} p) GROUP BY ALL"
    ),
    "boundary_leaks": (
        "SELECT doc_id, token, leaked FROM documents JOIN (VALUES (0, '[CLIENT_1]', 'Turbine Ltd.'), (1, '[CLIENT_2]', 'Big Power Holdings'), (3, "
        "'[CLIENT_1]', 'Capital')) AS t(place, token, leaked) ON doc_id % 5 = place"
    ),
    "completeness_score": _score(approved()),
    "revalidation": _score(approved() + ADDED),
    "verify_corpus": f"SELECT page_id, count(*)::BIGINT AS texts, sum(length(text))::BIGINT AS n_chars FROM {_PAGE} p WHERE channel IN ('text', 'metadata') GROUP BY ALL",
} | {f"residual_{c}": _left(f"(SELECT page_id, item, text FROM {_PAGE} p WHERE channel = '{c}')", "page_id, item::BIGINT AS item", LEAKY) for c in ("hyperlinks", "comments", "metadata")}
# Every place where a word starts, tested for the nested surfaces; a surface inside a longer one that begins before it is not claimed.
ORACLE["occurrence_rows"] = (
    "WITH c AS (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE text IS NOT NULL), "
    "s AS (SELECT doc_id, (i - 1)::INTEGER AS start, regexp_extract(substr(text, i, 80), '^((?:and|of)\\s+the|the|ing)(?:[^A-Za-z0-9]|$)', 1, 'i') AS surface "
    "FROM c WHERE lower(substr(text, i, 1)) IN ('a', 'o', 't', 'i') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9]'))), "
    "f AS MATERIALIZED (SELECT doc_id, start, (start + length(surface))::INTEGER AS stop, surface FROM s WHERE surface <> '') "
    "SELECT doc_id, start, stop, surface, entity_id FROM f a LEFT JOIN (SELECT lower(surface) AS key, min(entity_id) AS entity_id "
    f"FROM {values('dictionary')} d WHERE status = 'approved' GROUP BY ALL) e ON key = lower(surface) "
    "WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = a.doc_id AND b.start < a.start AND b.stop >= a.stop)"
)
ORACLE["residual_union"] = f"SELECT doc_id, leaked AS surface FROM ({ORACLE['boundary_leaks']}) a UNION ALL SELECT * FROM ({ORACLE['residual_text']}) b"
QUERIES = {name: globals()[name] for name in ORACLE}
