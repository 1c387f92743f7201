"""Queries on identifiers, chunks and dictionary matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import patterns as P
from corvane.operators import detect
from corvane.plans.fixtures import OWN_FIRM, literal, values
from corvane.sources.tables import table

SURFACES = ["the", "of the", "ing", "and the"]


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def pii_candidates(spark, folder):
    rows = detect.candidates(_docs(spark, folder).select("doc_id", F.lit(0).alias("chunk_id"), "text"))
    return rows.select("doc_id", "key", "surface", "entity_type", "occurrences")


def pii_type_by_lang(spark, folder):
    found = _docs(spark, folder).select("lang", F.explode(P.identifiers(F.col("text"))).alias("x"))
    return found.groupBy("lang", F.col("x.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def email_domain_inventory(spark, folder):
    docs = _docs(spark, folder).select(F.lit("documents").alias("origin"), "text")
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("origin"), F.concat_ws(" ", "url", "html").alias("text"))
    found = docs.unionByName(pages).select("origin", F.explode(P.identifiers(F.col("text"))).alias("x")).where("x.entity_type = 'CLIENT_EMAIL_DOMAIN'")
    return found.groupBy("origin", F.col("x.surface").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def phone_account_overlap(spark, folder):
    docs = _docs(spark, folder)
    phones = docs.select("doc_id", F.explode(P.matches(F.col("text"), P.PHONE)).alias("found"))
    accounts = docs.select("doc_id", F.explode(P.matches(F.col("text"), P.ACCOUNT)).alias("found"))
    return phones.intersect(accounts)


def candidate_contexts(spark, folder):
    rows = detect.candidates(_docs(spark, folder).select("doc_id", F.lit(0).alias("chunk_id"), "text"))
    return rows.select("doc_id", "key", F.get("contexts", F.lit(0)).alias("context"))


def chunk_paragraphs(spark, folder):
    return detect.chunks(_docs(spark, folder)).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def chunk_range_scan(spark, folder):
    rows = detect.chunk_range(detect.chunks(_docs(spark, folder)), 1, 2)
    return rows.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text")


def scanned_doc_heuristic(spark, folder):
    rows = detect.chunks(_docs(spark, folder), 1).groupBy("doc_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"), F.count(F.lit(1)).alias("chunks"))
    return rows.where(F.col("chars") < 50 * F.col("chunks"))


def occurrence_counts(spark, folder):
    return detect.occurrence_counts(_docs(spark, folder), SURFACES)


def dictionary_sweep(spark, folder):
    aliases = [(r["entity_id"], r["alias_id"], r["surface"]) for r in literal(spark, "dictionary").where("status = 'approved'").collect()]
    return detect.sweep(_docs(spark, folder), aliases, OWN_FIRM)


def dictionary_lookup(spark, folder):
    aliases = literal(spark, "dictionary").where("status <> 'skipped'").select(P.normalized("surface").alias("key"), "entity_id", "token")
    found = pii_candidates(spark, folder).withColumn("key", P.normalized("surface"))
    return found.join(aliases, "key").where(~detect.own_firm(F.col("surface"), OWN_FIRM)).select("doc_id", "key", "entity_id", "token")


def skipped_terms(spark, folder):
    words = _docs(spark, folder).select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \n]+"))).alias("surface")).where("length(surface) >= 8").withColumn("key", P.normalized_ascii(F.col("surface"))).where(~F.col("surface").rlike(r"[^\x00-\x7F]"))
    skipped = literal(spark, "dictionary").where("status = 'skipped'").select(P.normalized_ascii(F.col("surface")).alias("key"))
    return words.join(skipped, "key", "left_anti").groupBy("doc_id").agg(F.countDistinct("key").alias("terms"))


def _scored(spark, folder):
    found = pii_candidates(spark, folder)
    known = literal(spark, "dictionary").where("status <> 'skipped'").select(F.lower("surface").alias("key"), F.lit(True).alias("known"))
    confidence = (F.col("doc_id") % 10) / 10
    rows = found.join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.withColumn("confidence", detect.capped_confidence(F.col("surface"), confidence))


def confidence_gate(spark, folder):
    rows = detect.gated(_scored(spark, folder), literal(spark, "thresholds").withColumn("threshold", F.col("threshold").cast("double")))
    return rows.where("passes").select("doc_id", "key", "entity_type", F.round("confidence", 2).alias("confidence"))


def excluded_candidates(spark, folder):
    rows = detect.gated(_scored(spark, folder), literal(spark, "thresholds").withColumn("threshold", F.col("threshold").cast("double")))
    return rows.where("not passes").groupBy("entity_type", F.col("threshold").cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("n"))


def entity_merge_priority(spark, folder):
    docs = _docs(spark, folder)
    emitted = docs.select("doc_id", F.explode(P.identifiers(F.col("text"))).alias("x")).select("doc_id", F.lower("x.surface").alias("key"), "x.surface")
    by_phone = docs.select("doc_id", F.explode(P.matches(F.col("text"), P.PHONE)).alias("surface")).select("doc_id", F.lower("surface").alias("key"), "surface")
    sources = emitted.withColumn("source", F.lit("model")).unionByName(by_phone.withColumn("source", F.lit("dictionary")))
    return detect.merged_entities(sources).select("doc_id", "key", "source")


# --- the same in DuckDB's SQL ---

_E, _U, _PH, _AC = (p.replace("'", "''") for p in (P.EMAIL, P.URL_HOST, P.PHONE, P.ACCOUNT))
_PUBLIC = ", ".join(f"'{d}'" for d in P.PUBLIC_DOMAINS)


def _emitted(source: str, columns: str) -> str:
    """Rows (columns, kind order, position, surface, entity_type) of a text source."""
    parts = []
    for kind, (pattern, group) in enumerate(((_E, 1), (_U, 1), (_PH, 0), (_AC, 0))):
        surface, typ = ("lower(m)", "CLIENT_EMAIL_DOMAIN") if group else ("trim(m, ' ')", "CLIENT_CONTRACT_ID")
        parts.append(f"SELECT {columns}, {kind} AS kind, pos, {surface} AS surface, '{typ}' AS entity_type FROM (SELECT {columns}, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM (SELECT {columns}, regexp_extract_all(text, '{pattern}', {group}) AS ms FROM {source})) q" + (f" WHERE lower(m) NOT IN ({_PUBLIC})" if group else ""))
    return "(" + " UNION ALL ".join(parts) + ")"


_CAND = (
    f"SELECT doc_id, lower(surface) AS key, arg_min(surface, kind * 1000000 + pos) AS surface, arg_min(entity_type, kind * 1000000 + pos) AS entity_type, "
    f"count(*)::BIGINT AS occurrences FROM {_emitted('documents', 'doc_id')} e GROUP BY ALL"
)
_LINES = (
    "(SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), "
    "lambda x: trim(x, ' ') <> '') AS ls FROM documents))"
)
_CHUNKS = f"(SELECT doc_id, (i // 8)::BIGINT AS chunk_id, string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM {_LINES} l GROUP BY ALL)"
_DOUBLED = r"regexp_replace(text, '([^A-Za-z0-9])', '\1\1', 'g')"


def _found(surface: str) -> str:
    body = r"\s+".join(surface.split(" "))
    return f"(?i)(?:^|[^A-Za-z0-9]){body}(?:[^A-Za-z0-9]|$)"


_KEY = r"regexp_replace(regexp_replace(trim(lower({}), ' '), '[^\w@.\s-]', '', 'g'), '\s+', ' ', 'g')"
_SCORED = (
    f"(SELECT c.*, coalesce(k.known, false) AS known, CASE WHEN length(c.surface) < 4 THEN least((doc_id % 10) / 10, 0.6::DOUBLE - 0.01::DOUBLE) "
    f"ELSE (doc_id % 10) / 10 END AS confidence FROM ({_CAND}) c LEFT JOIN (SELECT lower(surface) AS key, true AS known FROM {values('dictionary')} d "
    f"WHERE status <> 'skipped') k USING (key))"
)
_GATED = f"(SELECT s.*, coalesce(t.threshold::DOUBLE, 0.6::DOUBLE) AS threshold FROM {_SCORED} s LEFT JOIN {values('thresholds')} t USING (entity_type))"

ORACLE = {
    "pii_candidates": _CAND,
    "pii_type_by_lang": f"SELECT lang, entity_type, count(*)::BIGINT AS n FROM {_emitted('documents', 'lang')} e GROUP BY ALL",
    "email_domain_inventory": f"""SELECT origin, surface AS domain, count(*)::BIGINT AS n FROM {_emitted("(SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'pages', concat_ws(' ', url, html) FROM pages)", 'origin')} e WHERE entity_type = 'CLIENT_EMAIL_DOMAIN' GROUP BY ALL""",
    "phone_account_overlap": (
        f"SELECT doc_id, unnest(regexp_extract_all(text, '{_PH}')) AS found FROM documents INTERSECT SELECT doc_id, unnest(regexp_extract_all(text, '{_AC}')) "
        f"FROM documents"
    ),
    "candidate_contexts": (
        f"SELECT doc_id, key, replace(substring(text, greatest(place - 40, 1), place + length(surface) + 40 - greatest(place - 40, 1)), chr(10), ' ') "
        f"AS context FROM (SELECT c.*, d.text, instr(lower(d.text), key) AS place FROM ({_CAND}) c JOIN documents d USING (doc_id))"
    ),
    "chunk_paragraphs": f"SELECT doc_id, chunk_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM {_CHUNKS} c",
    "chunk_range_scan": f"SELECT doc_id, chunk_id, text FROM {_CHUNKS} c WHERE chunk_id BETWEEN 1 AND 2",
    "scanned_doc_heuristic": (
        f"SELECT doc_id, sum(length(trim(line, ' ')))::BIGINT AS chars, count(*)::BIGINT AS chunks FROM {_LINES} l GROUP BY ALL HAVING sum(length(trim(line, "
        f"' '))) < 50 * count(*)"
    ),
    "occurrence_counts": " UNION ALL ".join(f"SELECT doc_id, '{s}' AS surface, n::BIGINT AS occurrences FROM (SELECT doc_id, len(regexp_extract_all({_DOUBLED}, '{_found(s)}')) AS n FROM documents) WHERE n > 0" for s in SURFACES),
    "dictionary_sweep": "SELECT doc_id, entity_id, arg_min(surface, alias_id) AS surface FROM (" + " UNION ALL ".join(f"SELECT doc_id, {e} AS entity_id, {a} AS alias_id, '{s}' AS surface FROM documents WHERE regexp_matches({_DOUBLED}, '{_found(s)}')" for e, a, s in ((1, 1, "the"), (2, 2, "of the"), (3, 3, "ing"), (4, 4, "and the"), (2, 5, "at the"))) + ") GROUP BY ALL",
    "dictionary_lookup": (
        f"SELECT doc_id, k AS key, entity_id, token FROM (SELECT doc_id, surface, {_KEY.format('surface')} AS k FROM ({_CAND})) c "
        f"JOIN (SELECT {_KEY.format('surface')} AS k, entity_id, token FROM {values('dictionary')} d WHERE status <> 'skipped') a USING (k) "
        f"WHERE NOT regexp_matches(surface, '(?i)(^|[^A-Za-z0-9])(anon|firm)([^A-Za-z0-9]|$)')"
    ),
    "skipped_terms": (
        f"SELECT doc_id, count(DISTINCT key)::BIGINT AS terms FROM (SELECT doc_id, {_KEY.format('surface')} AS key FROM (SELECT doc_id, "
        f"unnest(regexp_split_to_array(text, '[ \\n]+')) AS surface FROM documents) WHERE length(surface) >= 8 AND NOT regexp_matches(surface, "
        f"'[^\\x00-\\x7F]')) w WHERE key NOT IN (SELECT {_KEY.format('surface')} FROM {values('dictionary')} d WHERE status = 'skipped') GROUP BY ALL"
    ),
    "confidence_gate": f"SELECT doc_id, key, entity_type, round(confidence, 2)::DOUBLE AS confidence FROM {_GATED} g WHERE known OR confidence >= threshold",
    "excluded_candidates": f"SELECT entity_type, threshold, count(*)::BIGINT AS n FROM {_GATED} g WHERE NOT (known OR confidence >= threshold) GROUP BY ALL",
    "entity_merge_priority": (
        f"SELECT doc_id, key, CASE min(p) WHEN 1 THEN 'dictionary' ELSE 'model' END AS source FROM (SELECT doc_id, lower(surface) AS key, 2 AS p "
        f"FROM {_emitted('documents', 'doc_id')} e UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_PH}'))), 1 FROM documents) GROUP BY ALL"
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE}
