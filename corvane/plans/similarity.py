"""Queries on duplicates and on image verdicts, over hashes made of the embeddings' signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.patterns import sign_hash, surface_regex
from corvane.operators import detect, similarity
from corvane.plans.fixtures import OWN_FIRM, literal, values
from corvane.sources.tables import table

#: Bits that may differ: hashes of unlike vectors differ in about 32.
WIDE, NEAR = 15, 24


def _hashes(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", sign_hash(F.col("embedding")).alias("phash"))


def exact_dup_groups(spark, folder):
    return similarity.exact_groups(table(spark, folder, "documents"), F.col("text"), "doc_id").where("n > 1")


def phash_from_embedding(spark, folder):
    return _hashes(spark, folder).select("vec_id", "phash")


def _references(rows):
    """Every row whose id is divisible by 100, against all rows."""
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("ref"), "phash")


def hamming_matches(spark, folder):
    rows = _hashes(spark, folder)
    return similarity.hamming_matches(rows.select(F.col("vec_id").alias("probe"), "phash"), _references(rows), WIDE).withColumn("distance", F.col("distance").cast("int"))


def band_vs_full_scan(spark, folder):
    """Pairs that only one of the banded and the full comparison finds: none. The references are the query set, in blocks of one for each."""
    rows = _hashes(spark, folder)
    probes, refs = rows.select(F.col("vec_id").alias("probe"), "phash"), _references(rows)
    banded = similarity.hamming_matches(probes, refs, WIDE, banded=True).select("probe", "ref")
    # Each hash becomes a number once, not once for each pair.
    told = lambda side, key, number: side.where(F.col("phash").rlike(similarity.HASH)).select(key, F.conv("phash", 16, -10).cast("long").alias(number))
    full = told(probes, "probe", "x").join(told(refs, "ref", "y"), F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= WIDE).select("probe", "ref")
    return banded.exceptAll(full).unionByName(full.exceptAll(banded))


def best_logo(spark, folder):
    return similarity.best_match(hamming_matches(spark, folder)).withColumn("distance", F.col("distance").cast("int"))


def logo_levels(spark, folder):
    """Pictures that are copies of a stored logo, each with some bits changed, by how sure the nearest one is: confident, uncertain or none."""
    rows = _hashes(spark, folder)
    refs = _references(rows)
    number = F.conv("phash", 16, -10).cast("long").bitwiseXOR(F.expr("shiftleft(1L, cast(vec_id % 20 as int)) - 1"))
    copies = rows.select("vec_id", (F.col("vec_id") - F.col("vec_id") % 100).alias("ref")).join(refs, "ref").select(F.col("vec_id").alias("probe"), F.lpad(F.lower(F.hex(number)), 16, "0").alias("phash"))
    best = similarity.best_match(similarity.hamming_matches(copies, refs, similarity.UNCERTAIN))
    level = F.when(F.col("distance") <= similarity.CONFIDENT, "confident").when(F.col("distance") <= similarity.UNCERTAIN, "uncertain").otherwise("none")
    return copies.select("probe").join(best, "probe", "left").select("probe", "ref", F.col("distance").cast("int").alias("distance"), level.alias("level"))


def greedy_clusters(spark, folder):
    """Every 50 vectors in a row are the images of one document."""
    rows = _hashes(spark, folder).select(F.floor(F.col("vec_id") / 50).alias("group"), F.col("vec_id").alias("idx"), "phash")
    return similarity.greedy_clusters(rows, NEAR).withColumnRenamed("group", "owner")


def similarity_components(spark, folder):
    rows = _hashes(spark, folder).select(F.col("vec_id").alias("key"), "phash")
    return similarity.similar_components(rows, WIDE)


def merged_clusters(spark, folder):
    rows = _hashes(spark, folder)
    parts = similarity_components(spark, folder)
    logo = best_logo(spark, folder).select(F.col("probe").alias("idx"), F.col("distance").alias("logo_distance"))
    verdicts = literal(spark, "verdicts")
    members = rows.select(F.col("vec_id").alias("idx"), (F.col("vec_id") % 10).cast("int").alias("label")).join(verdicts, "label").withColumn("confidence", F.col("confidence").cast("double"))
    members = members.join(parts.withColumnRenamed("node", "idx"), "idx").join(logo, "idx", "left")
    return similarity.merged_clusters(members)


def memo_misses(spark, folder):
    wanted = table(spark, folder, "embeddings").select(F.col("label").alias("run_id"), F.concat(F.lit("sha256:"), F.sha2(F.col("vec_id").cast("string"), 256)).alias("content_key"))
    memo = wanted.where("run_id % 2 = 0")
    return similarity.memo_misses(wanted, memo).groupBy("run_id").agg(F.count(F.lit(1)).alias("misses"))


def _judged(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 10).cast("int").alias("label")).join(literal(spark, "verdicts"), "label").withColumn("confidence", F.col("confidence").cast("double"))
    logo = best_logo(spark, folder).select(F.col("probe").alias("vec_id"), F.col("distance").alias("logo_distance"))
    rows = rows.join(logo, "vec_id", "left").select("vec_id", "flagged", "confidence", "ocr", "logo_distance")
    known = F.col("ocr").rlike(surface_regex("the")) | F.col("ocr").rlike(surface_regex("ing"))
    return similarity.identity_rules(rows, known, detect.own_firm(F.col("ocr"), OWN_FIRM))


def image_identity_rules(spark, folder):
    return _judged(spark, folder).select("vec_id", "identity", F.round("confidence", 3).alias("confidence"), "judgment")


def image_approval(spark, folder):
    """Redacted images: flagged and not excluded by the reviewer, opted in, or mandatory."""
    matches = hamming_matches(spark, folder).withColumn("entity_id", (F.col("ref") / 100).cast("int") % 8 + 1)
    must = similarity.mandatory_images(matches, literal(spark, "dictionary"), NEAR).select(F.col("probe").alias("vec_id"), F.lit(True).alias("mandatory"))
    rows = _judged(spark, folder).join(must, "vec_id", "left")
    excluded, included = F.col("vec_id") % 7 == 0, F.col("vec_id") % 11 == 0
    return rows.where((F.col("identity") & ~excluded) | included | F.col("mandatory")).select("vec_id")


_BITS = "list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')"
_H = f"(SELECT vec_id, label, {_BITS} AS bits FROM embeddings)"
_D = "list_sum(list_transform(generate_series(1, 64), lambda i: (a.bits[i] <> b.bits[i])::INT))"
_PAIRS = f"(SELECT a.vec_id AS probe, b.vec_id AS ref, {_D}::INTEGER AS distance FROM {_H} a, {_H} b WHERE b.vec_id % 100 = 0 AND {_D} <= {WIDE})"
_BEST = f"(SELECT probe, arg_min(ref, distance * 1000000 + ref) AS ref, min(distance) AS distance FROM {_PAIRS} p GROUP BY probe)"
_COMPONENTS = f"""(WITH RECURSIVE h AS MATERIALIZED {_H}, e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM h a, h b WHERE {_D} <= {WIDE}),
r(node, reached) AS (SELECT x, y FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x) SELECT node, min(reached) AS component FROM r GROUP BY node)"""
_KNOWN = "regexp_matches(coalesce(ocr, ''), '(?i)(^|[^A-Za-z0-9])(the|ing)([^A-Za-z0-9]|$)')"
_OWN = "regexp_matches(coalesce(ocr, ''), '(?i)(^|[^A-Za-z0-9])(anon|firm)([^A-Za-z0-9]|$)')"
_RULES = f"""(SELECT *, (flagged OR known OR sure) AND NOT own AS identity, NOT own AND (unsure OR (c BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE AND NOT ((flagged OR known OR sure) AND NOT own))) AS judgment FROM
(SELECT *, CASE WHEN known OR sure THEN greatest(confidence, 0.95::DOUBLE) ELSE confidence END AS c FROM
(SELECT e.vec_id, v.flagged, v.confidence::DOUBLE AS confidence, {_KNOWN} AS known, {_OWN} AS own, coalesce(distance <= 4, false) AS sure, coalesce(distance > 4 AND distance <= 10, false) AS unsure FROM embeddings e JOIN {values('verdicts')} v ON v.label = e.vec_id % 10 LEFT JOIN {_BEST} b ON b.probe = e.vec_id)))"""

ORACLE = {
    "exact_dup_groups": "SELECT sha256(text) AS digest, min(doc_id) AS first, count(*)::BIGINT AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "phash_from_embedding": "SELECT vec_id, string_agg(format('{:x}', (bits[4 * i + 1]::INT * 8 + bits[4 * i + 2]::INT * 4 + bits[4 * i + 3]::INT * 2 + bits[4 * i + 4]::INT)), '' ORDER BY i) AS phash FROM " + _H + " h, generate_series(0, 15) AS g(i) GROUP BY vec_id",
    "hamming_matches": f"SELECT * FROM {_PAIRS} p",
    "band_vs_full_scan": "SELECT vec_id AS probe, vec_id AS ref FROM embeddings WHERE false",
    "logo_levels": (
        f"WITH h AS MATERIALIZED {_H}, p AS (SELECT e.vec_id AS probe, b.bits, e.vec_id % 20 AS k FROM h e JOIN h b ON b.vec_id = e.vec_id - e.vec_id % 100), "
        f"m AS (SELECT probe, r.vec_id AS ref, list_sum(list_transform(generate_series(1, 64), lambda i: ((p.bits[i] <> r.bits[i]) "
        f"<> (i > 64 - k))::INT))::INTEGER AS distance FROM p, h r WHERE r.vec_id % 100 = 0), b AS (SELECT probe, arg_min(ref, distance * 1000000 + ref) "
        f"AS ref, min(distance) AS distance FROM m WHERE distance <= 10 GROUP BY probe) SELECT p.probe, b.ref, b.distance, CASE "
        f"WHEN b.distance <= 4 THEN 'confident' WHEN b.distance <= 10 THEN 'uncertain' ELSE 'none' END AS level FROM p LEFT JOIN b USING (probe)"
    ),
    "best_logo": f"SELECT * FROM {_BEST} b",
    # One image after another, with the heads of the clusters so far in a list.
    "greedy_clusters": f"""WITH RECURSIVE h AS MATERIALIZED (SELECT vec_id // 50 AS g, vec_id, bits, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS i FROM {_H} x),
r AS (SELECT g, 0::BIGINT AS i, NULL::BIGINT AS idx, []::VARCHAR[] AS heads, NULL::BIGINT AS place FROM (SELECT DISTINCT g FROM h) z
UNION ALL SELECT g, i, idx, CASE WHEN place IS NULL THEN list_append(heads, bits) ELSE heads END, coalesce(place, len(heads) + 1) FROM
(SELECT h.g, h.i, h.vec_id AS idx, heads, bits, list_position(list_transform(heads, lambda x: list_sum(list_transform(generate_series(1, 64), lambda k: (x[k] <> bits[k])::INT)) <= {NEAR}), true) AS place FROM r JOIN h ON h.g = r.g AND h.i = r.i + 1))
SELECT g AS owner, idx, (place - 1)::INTEGER AS cluster, place <= 150 AS scanned FROM r WHERE i > 0""",
    "similarity_components": f"SELECT * FROM {_COMPONENTS} c",
    "merged_clusters": (
        f"WITH m AS MATERIALIZED (SELECT c.component, c.node AS idx, v.flagged, v.confidence::DOUBLE AS confidence, v.ocr, b.distance FROM {_COMPONENTS} c "
        f"JOIN {values('verdicts')} v ON v.label = c.node % 10 LEFT JOIN {_BEST} b ON b.probe = c.node) SELECT component, max(confidence) AS confidence, "
        f"bool_or(flagged) AS flagged, string_agg(idx, ',' ORDER BY idx) AS indices, arg_max(idx, confidence * 1000000 - idx) AS primary_idx, "
        f"min(distance)::INTEGER AS logo_distance, arg_min(ocr, idx) FILTER (ocr IS NOT NULL) AS ocr, coalesce((SELECT string_agg(o, ',' ORDER BY i) "
        f"FROM (SELECT q.ocr AS o, min(q.idx) AS i FROM m q WHERE q.component = m.component AND q.ocr IS NOT NULL GROUP BY q.ocr)), '') AS ocrs, row_number() "
        f"OVER (ORDER BY min(idx)) - 1 AS number FROM m GROUP BY component"
    ),
    "memo_misses": "SELECT label AS run_id, count(DISTINCT vec_id)::BIGINT AS misses FROM embeddings WHERE label % 2 <> 0 GROUP BY label",
    "image_identity_rules": f"SELECT vec_id, identity, round(c, 3) AS confidence, judgment FROM {_RULES} r",
    "image_approval": (
        f"SELECT vec_id FROM {_RULES} r WHERE (identity AND vec_id % 7 <> 0) OR vec_id % 11 = 0 OR vec_id IN (SELECT probe FROM {_PAIRS} p "
        f"JOIN {values('dictionary')} d ON d.entity_id = ref // 100 % 8 + 1 WHERE d.status = 'approved')"
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE}
