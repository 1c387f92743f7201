"""Queries on requests against snapshots, counts over channels, lists, and checks of what was read from images."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.patterns import ACCOUNT, UNICODE
from corvane.operators import detect, lifecycle, scrub, similarity, upkeep
from corvane.plans import detection, governance, review
from corvane.plans import similarity as images
from corvane.plans.fixtures import OWN_FIRM, approved, literal, values
from corvane.plans.masking import _replaced
from corvane.sources.tables import table

ROLES = ("admin", "km_governance", "km_reviewer", "practice_lead", "delivery", "read_only")
ASKED = ("admin", "km_reviewer", "nobody", "delivery")
#: From this confidence on a document may still be recognised; characters that a summary reads.
REID_FROM, EXCERPT_CHARS = 0.5, 1500
SHOWN_NAMES, SHOWN_LOGOS, CAP = 10, 6, 5


def _people(spark, folder):
    return governance._people(spark, folder).select("user_id", "role")


def _owners(spark, folder):
    return table(spark, folder, "customer").where("c_custkey % 12 = 3").select(F.col("c_nationkey").alias("account"), F.col("c_custkey").alias("user_id"))


def owner_changes(spark, folder):
    """Every order asks for its customer to own, or not to own, the customer's nation."""
    asked = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    requests = asked.select(F.col("c_nationkey").alias("account"), F.col("c_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "remove").otherwise("assign").alias("action"))
    return upkeep.owner_changes(_owners(spark, folder), requests, _people(spark, folder))


def owners_after(spark, folder):
    return upkeep.owners_after(_owners(spark, folder), owner_changes(spark, folder))


def role_changes(spark, folder):
    asked = F.element_at(F.array(*[F.lit(r) for r in ASKED]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    requests = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), asked.alias("role"))
    roles = spark.createDataFrame([(r,) for r in ROLES], "role string")
    return upkeep.role_changes(_people(spark, folder), requests, roles)


def roles_after(spark, folder):
    return upkeep.roles_after(_people(spark, folder), role_changes(spark, folder))


def term_requests(spark, folder):
    docs = table(spark, folder, "documents")
    kinds = [docs.select(F.lit(category).alias("category"), F.concat(F.lit(" "), F.upper(column)).alias("value"), (F.col("doc_id") % 2 == 0).alias("manager"), F.col("doc_id").alias("seq")) for category, column in (("technology", "source"), ("domain", "lang"), ("geography", "lang"))]
    return upkeep.term_requests(literal(spark, "vocabulary"), kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))


def terms_decided(spark, folder):
    """Terms from the documents; every nation's name and language decides on some, more than once."""
    docs = table(spark, folder, "documents")
    kinds = docs.select(F.lit("technology").alias("category"), F.col("source").alias("value"), "doc_id").unionByName(docs.select(F.lit("domain").alias("category"), F.col("lang").alias("value"), "doc_id"))
    decision = F.when(F.col("doc_id") % 97 == 5, "delete").when(F.col("doc_id") % 3 == 1, "approve")
    decisions = kinds.where("category = 'domain' or doc_id % 2 = 0").select("category", "value", decision.alias("decision")).where("decision is not null and value <> 'en'")
    return upkeep.terms_decided(term_requests(spark, folder), decisions)


def statuses_decided(spark, folder):
    """A supplier's status and nation, decided on by the orders of the customer with its number, in order of their keys."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending_approval", "approved", "skipped")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    entities = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("entity_id"), status.alias("status"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("account"))
    decision = F.element_at(F.array(*[F.lit(x) for x in ("approve", "skip", "unskip", "look")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    linked = F.when(F.col("o_orderkey") % 8 == 0, F.col("o_custkey").cast("int") % 25)
    decisions = table(spark, folder, "orders").select(F.col("o_custkey").alias("entity_id"), decision.alias("decision"), linked.alias("account"), F.col("o_orderkey").alias("seq"))
    return upkeep.statuses_decided(entities, decisions)


def entities_created(spark, folder):
    return upkeep.entities_created(literal(spark, "dictionary"), detection.pii_candidates(spark, folder).select("surface", "entity_type"))


def references_stored(spark, folder):
    rows = images._hashes(spark, folder).select(F.col("label").alias("entity_id"), "phash", "vec_id")
    new = rows.where("vec_id % 100 <> 0").select("entity_id", F.when(F.col("vec_id") % 2 == 0, F.col("phash")).otherwise(" ").alias("phash"))
    return upkeep.references_stored(rows.where("vec_id % 100 = 0").select("entity_id", "phash"), new).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def step_order(spark, folder):
    items = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "run_id").withColumn("seq", F.col("l_linenumber") * 10000000 + F.col("l_partkey"))
    own = F.when(F.col("l_partkey") % 5 == 0, F.col("l_linenumber") + 100).when(F.col("l_partkey") % 5 == 1, F.lit(0))
    return upkeep.ordered_steps(items.where("l_linenumber <= 2"), items.where("l_linenumber > 2").withColumn("own_order", own))


def run_confidence(spark, folder):
    found = table(spark, folder, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 100 / 100).alias("confidence"))
    return upkeep.run_confidence(table(spark, folder, "customer").select(F.col("c_custkey").alias("run_id")), found)


def _groups(spark, folder):
    """Every 50 vectors are a group; the keys are what was read on them."""
    rows = table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 10).cast("int").alias("label"))
    return rows.join(literal(spark, "verdicts"), "label").select(F.floor(F.col("vec_id") / 50).alias("group_id"), F.col("ocr").alias("key"), F.col("vec_id").alias("idx"))


def image_occurrences(spark, folder):
    return upkeep.image_occurrences(_groups(spark, folder))


def alt_text_occurrences(spark, folder):
    return review.alt_text_ladder(spark, folder).groupBy(F.lower("entity").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def total_occurrences(spark, folder):
    text = detection.occurrence_counts(spark, folder).groupBy(F.col("surface").alias("key")).agg(F.sum("occurrences").alias("n"))
    return upkeep.total_occurrences(text, image_occurrences(spark, folder), alt_text_occurrences(spark, folder))


def _said(spark, folder):
    words = F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")
    return table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(words).alias("ord", "text"))


def _read(spark, folder):
    """What is read on an image for each turn: its words, at the end a number, and for some, before all, one of the own firm's or a number."""
    said = _said(spark, folder).select("conv_id", "turn", F.col("ord").cast("long").alias("ord"), "text")
    number = F.lit(700000) + F.col("conv_id") * 10 + F.col("turn")
    first = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Anon "), number)).when(F.col("conv_id") % 4 == 1, F.concat(F.lit(" AB-"), number)).when(F.col("conv_id") % 4 == 2, F.lit(" "))
    ends = F.array(F.struct(F.lit(-1).cast("long").alias("ord"), first.alias("text")), F.struct(F.lit(1000000).cast("long").alias("ord"), number.cast("string").alias("text")))
    planted = table(spark, folder, "conversations").select("conv_id", "turn", F.inline(ends)).where("text is not null")
    return said.unionByName(planted).withColumn("key", F.concat_ws("-", "conv_id", "turn"))


def first_known(spark, folder):
    """The first name or number that is read on the image of each turn of a conversation."""
    names = literal(spark, "dictionary").where("status = 'approved'").select("surface", F.col("entity_id").alias("entity"))
    return upkeep.first_known(_read(spark, folder), names, detect.own_firm(F.col("text"), OWN_FIRM), UNICODE + ACCOUNT)


def readable_fragments(spark, folder):
    skipped = literal(spark, "dictionary").where("status = 'skipped'")
    return upkeep.readable_fragments(_said(spark, folder), detect.own_firm(F.col("text"), OWN_FIRM), skipped).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _covers(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 10).cast("int").alias("label")).join(literal(spark, "verdicts"), "label")
    texts = F.when(F.col("label") == 3, F.array(F.lit("REDACTED"), F.lit(" redacted "))).when(F.col("ocr").isNotNull(), F.array("ocr")).otherwise(F.expr("cast(array() as array<string>)"))
    pixels = F.transform("embedding", lambda x: 60 + 90 * x.cast("double"))
    return rows.select("vec_id", upkeep.is_placeholder(texts, pixels).alias("cover"))


def placeholders(spark, folder):
    return _covers(spark, folder)


def residual_images(spark, folder):
    """Images of the approved groups that are no covers."""
    covers = _covers(spark, folder).where("cover").select(F.col("vec_id").alias("idx"))
    return review.redacted_images(spark, folder).join(covers, "idx", "left_anti").select("group_id", "idx")


def fresh_hits(spark, folder):
    text = F.when(F.col("page_id") % 5 == 0, "[CLIENT_PERSON_12]").when(F.col("page_id") % 5 == 1, "  ").when(F.col("page_id") % 5 == 2, "of Anon").otherwise(F.col("url"))
    return upkeep.fresh_hits(table(spark, folder, "pages").select("page_id", text.alias("text")), detect.own_firm(F.col("text"), OWN_FIRM))


def reidentifiable(spark, folder):
    return table(spark, folder, "documents").select("doc_id", (F.col("doc_id") % 10 / 10).alias("confidence")).where(F.col("confidence") >= REID_FROM)


def precision_misses(spark, folder):
    found = detection.pii_candidates(spark, folder).select(F.col("doc_id").alias("run_id"), "surface", "entity_type")
    removed = found.where("run_id % 3 = 0 and length(surface) % 2 = 0").select("run_id", F.upper("surface").alias("surface"))
    return upkeep.precision_misses(found, removed)


def visual_merge(spark, folder):
    rows = images._hashes(spark, folder)
    logo = F.when(F.col("vec_id") % 13 == 0, F.col("vec_id") % 7)
    brand = F.when(F.col("vec_id") % 17 == 0, F.concat(F.lit("b"), F.col("vec_id") % 5))
    return similarity.visually_merged(rows.select(F.col("vec_id").alias("key"), "phash", logo.alias("logo"), brand.alias("brand")), images.WIDE)


def own_firm_logos(spark, folder):
    """Vectors near any of the firm's own, which are the references."""
    rows = images._hashes(spark, folder)
    return similarity.near_any(rows, images._references(rows), images.NEAR).select("vec_id")


def entity_children(spark, folder):
    """Each nation with its suppliers' names, its region and its newest logos; every child list is aggregated before it is joined."""
    names = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.array_join(F.slice(F.array_sort(F.collect_list("s_name")), 1, SHOWN_NAMES), "|").alias("aliases"))
    logos = table(spark, folder, "embeddings").groupBy((F.col("vec_id") % 30).cast("int").alias("n_nationkey")).agg(F.array_join(F.slice(F.sort_array(F.collect_list("vec_id"), False), 1, SHOWN_LOGOS), ",").alias("logos"))
    nations = table(spark, folder, "nation")
    rows = nations.join(names, nations["n_nationkey"] == names["s_nationkey"], "left").join(logos, "n_nationkey", "left").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("n_name", "aliases", F.col("r_name").alias("account"), "logos")


def tagging_source(spark, folder):
    """Completed runs with the name of who started them."""
    done = lifecycle.latest(governance._events(spark, folder), "user_id", ["ts", "event_id"], "status", "event_id").where("status = 'completed'")
    return done.join(table(spark, folder, "customer"), F.col("user_id") == F.col("c_custkey")).select("user_id", "event_id", F.col("c_name").alias("name"))


def group_totals(spark, folder):
    rows = images._judged(spark, folder).groupBy(F.floor(F.col("vec_id") / 50).alias("group_id"))
    return rows.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("identity")).alias("flagged"), F.count_if(F.col("judgment")).alias("judgment"))


def skipped_clusters(spark, folder):
    return similarity.skipped_clusters(images.greedy_clusters(spark, folder).withColumnRenamed("owner", "group"), CAP).withColumnRenamed("group", "owner")


def thresholds_used(spark, folder):
    rows = detect.gated(detection._scored(spark, folder), literal(spark, "thresholds").withColumn("threshold", F.col("threshold").cast("double")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("threshold")), lambda x: F.format_string("%.2f", x)), ",").alias("thresholds"))


def excerpts(spark, folder):
    """The beginning that a summary reads of each text; the limit is the feature."""
    return table(spark, folder, "documents").select("doc_id", F.md5(F.substring("text", 1, EXCERPT_CHARS)).alias("digest"))


def runs_newest(spark, folder):
    return upkeep.newest_first(table(spark, folder, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "place")


def documents_newest(spark, folder):
    return table(spark, folder, "documents").where("source = 'src1'").orderBy(F.col("doc_id").desc()).select("doc_id", "lang")


def users_newest(spark, folder):
    return table(spark, folder, "customer").orderBy(F.col("c_custkey").desc()).select("c_custkey", "c_name")


def vocabulary_sorted(spark, folder):
    return governance.terms(spark, folder).orderBy("category", "value")


def proposals(spark, folder):
    return term_requests(spark, folder).where("status = 'pending_approval'").orderBy("category", "value").select("category", "value")


def accounts_by_name(spark, folder):
    return table(spark, folder, "nation").orderBy("n_name").select("n_name", "n_regionkey")


def mask_maps(spark, folder):
    old, new = F.create_map(F.lit("x"), F.lit("old"), F.col("c_mktsegment"), F.lit("old")), F.create_map(F.col("c_mktsegment"), F.lit("new"))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries(upkeep.with_new_entries(old, new))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, folder, "customer").select("c_custkey", merged.alias("entries"))


def scrub_titles(spark, folder):
    title = F.regexp_extract(scrub.scrubbed_elements(F.col("html"), ["title"], approved()), "(?s)<title>(.*?)</title>", 1)
    return table(spark, folder, "pages").select("page_id", title.alias("title"))


def page_node_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(scrub.node_text(F.col("html"))).alias("digest"))


_REQUESTS = (
    "(SELECT c_nationkey AS account, c_custkey AS user_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'assign' END AS action "
    "FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0 OR c_custkey % 6 = 3)"
)
_ROLE = f"{list(ROLES)}[c_custkey % 6 + 1]"
_ROLES = (
    f"(SELECT o_custkey AS user_id, o_orderkey AS seq, {list(ASKED)}[o_orderkey % 4 + 1] AS role FROM orders WHERE o_orderkey % 4 <> 2 "
    f"AND o_custkey IN (SELECT c_custkey FROM customer))"
)
_TERMS = f"""(SELECT category, value, status FROM {values('vocabulary')} v UNION ALL SELECT category, value, arg_min(CASE WHEN doc_id % 2 = 0 THEN 'approved' ELSE 'pending_approval' END, doc_id) FROM
(SELECT doc_id, unnest(['technology', 'domain', 'geography']) AS category, unnest([lower(source), lower(lang), lower(lang)]) AS value FROM documents) d WHERE (category, value) NOT IN (SELECT category, value FROM {values('vocabulary')} w) GROUP BY category, value)"""
_IMAGES = (
    f"(SELECT key, sum(size)::BIGINT AS n FROM (SELECT DISTINCT vec_id // 50 AS g, ocr AS key FROM embeddings "
    f"JOIN {values('verdicts')} v ON v.label = vec_id % 10 WHERE ocr IS NOT NULL) k JOIN (SELECT vec_id // 50 AS g, count(*) AS size FROM embeddings "
    f"GROUP BY ALL) s USING (g) GROUP BY key)"
)
_ALT = f"(SELECT lower(entity) AS key, count(*)::BIGINT AS n FROM ({review.ORACLE['alt_text_ladder']}) a GROUP BY ALL)"
_TEXT = f"(SELECT surface AS key, sum(occurrences)::BIGINT AS n FROM ({detection.ORACLE['occurrence_counts']}) o GROUP BY ALL)"
_SAID = (
    "(SELECT conv_id, turn, unnest(w) AS text, generate_subscripts(w, 1) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, "
    "'[ \\n]+'), lambda x: x <> '') AS w FROM conversations))"
)
_NUMBER = "(700000 + conv_id * 10 + turn)"
_READ = (
    f"(SELECT conv_id || '-' || turn AS key, i, text FROM {_SAID} w UNION ALL SELECT conv_id || '-' || turn, 1000000, {_NUMBER}::VARCHAR FROM conversations "
    f"UNION ALL SELECT conv_id || '-' || turn, -1, CASE conv_id % 4 WHEN 0 THEN 'Anon ' || {_NUMBER} WHEN 1 THEN ' AB-' || {_NUMBER} ELSE ' ' END "
    f"FROM conversations WHERE conv_id % 4 < 3)"
)
_NOT_OWN = "NOT regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(anon|firm)([^A-Za-z0-9]|$)')"
_COVER = f"(SELECT vec_id, vec_id % 10 = 3 OR len(list_filter(embedding, lambda x: abs(90 * x::DOUBLE) <= 15)) > 0.85::DOUBLE * len(embedding) AS cover FROM embeddings)"
_MERGED = f"""(WITH RECURSIVE h AS MATERIALIZED {images._H}, e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM h a, h b WHERE {images._D} <= {images.WIDE} OR (a.vec_id % 13 = 0 AND b.vec_id % 13 = 0 AND a.vec_id % 7 = b.vec_id % 7) OR (a.vec_id % 17 = 0 AND b.vec_id % 17 = 0 AND a.vec_id % 5 = b.vec_id % 5)),
r(node, reached) AS (SELECT x, y FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x) SELECT node, min(reached) AS component FROM r GROUP BY node)"""
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_PLAIN_TITLE = f"replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')"

ORACLE = {
    "owner_changes": (
        f"SELECT account, user_id, seq, action FROM (SELECT *, coalesce(lag(action) OVER (PARTITION BY account, user_id ORDER BY seq) = 'assign', "
        f"user_id % 12 = 3) AS owned FROM {_REQUESTS} q) w WHERE (action = 'assign') <> owned"
    ),
    "owners_after": (
        f"SELECT c_nationkey AS account, c_custkey AS user_id FROM customer LEFT JOIN (SELECT user_id, arg_max(action, seq) AS final FROM {_REQUESTS} q "
        f"GROUP BY user_id) l ON user_id = c_custkey WHERE coalesce(final = 'assign', c_custkey % 12 = 3)"
    ),
    "role_changes": (
        f"SELECT user_id, seq, coalesce(lag(role) OVER (PARTITION BY user_id ORDER BY seq), {_ROLE}) AS old, role FROM {_ROLES} q "
        f"JOIN customer ON c_custkey = user_id"
    ),
    "roles_after": (
        f"SELECT c_custkey AS user_id, coalesce(final, {_ROLE}) AS role FROM customer LEFT JOIN (SELECT user_id, arg_max(role, seq) AS final FROM {_ROLES} q "
        f"GROUP BY user_id) l ON user_id = c_custkey"
    ),
    "term_requests": f"SELECT * FROM {_TERMS} t",
    "terms_decided": (
        f"SELECT category, value, CASE WHEN approved THEN 'approved' ELSE status END AS status FROM {_TERMS} t LEFT JOIN (SELECT category, value, "
        f"bool_or(doc_id % 97 = 5) AS gone, bool_or(doc_id % 97 <> 5 AND doc_id % 3 = 1) AS approved FROM (SELECT 'technology' AS category, source AS value, "
        f"doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'domain', lang, doc_id FROM documents) k WHERE value <> 'en' AND (doc_id % 97 = 5 "
        f"OR doc_id % 3 = 1) GROUP BY ALL) d USING (category, value) WHERE NOT coalesce(gone, false)"
    ),
    "statuses_decided": (
        "SELECT s_suppkey AS entity_id, coalesce(d.status, ['pending_approval', 'approved', 'skipped'][s_suppkey % 3 + 1]) AS status, coalesce(d.account, CASE "
        "WHEN s_suppkey % 2 = 0 THEN s_nationkey END)::INTEGER AS account FROM supplier LEFT JOIN (SELECT o_custkey, arg_max(['approved', 'skipped', "
        "'pending_approval'][o_orderkey % 4 + 1], o_orderkey) FILTER (o_orderkey % 4 < 3) AS status, arg_max(o_custkey % 25, o_orderkey) "
        "FILTER (o_orderkey % 8 = 0) AS account FROM orders GROUP BY o_custkey) d ON o_custkey = s_suppkey"
    ),
    "entities_created": governance.allocated(f"SELECT *, {governance.PREFIX_OF} FROM (SELECT min(surface) AS surface, min(entity_type) AS kind FROM (SELECT surface, entity_type, {detection._KEY.format('surface')} AS key FROM ({detection._CAND})) WHERE key NOT IN (SELECT {detection._KEY.format('surface')} FROM {values('dictionary')} d) GROUP BY key)", f"(SELECT list(token) FROM {values('dictionary')} d)"),
    "references_stored": "SELECT label AS entity_id, count(*)::BIGINT AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label",
    "step_order": (
        "SELECT run_id, seq, coalesce(CASE WHEN l_partkey % 5 = 0 THEN l_linenumber + 100 END, place + (SELECT count(*) FROM lineitem b "
        "WHERE b.l_orderkey = run_id AND b.l_linenumber <= 2))::BIGINT AS step_order FROM (SELECT l_orderkey AS run_id, "
        "l_linenumber * 10000000 + l_partkey AS seq, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey "
        "ORDER BY l_linenumber * 10000000 + l_partkey) AS place FROM lineitem WHERE l_linenumber > 2) n"
    ),
    "run_confidence": (
        "SELECT c_custkey AS run_id, coalesce(min(o_orderkey % 100 / 100), 1.0)::DOUBLE AS confidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey "
        "GROUP BY c_custkey"
    ),
    "image_occurrences": f"SELECT * FROM {_IMAGES} i",
    "alt_text_occurrences": f"SELECT * FROM {_ALT} a",
    "total_occurrences": (
        f"SELECT key, sum(t)::BIGINT AS in_text, sum(i)::BIGINT AS in_images, sum(a)::BIGINT AS in_alt, sum(t + i + a)::BIGINT AS total FROM (SELECT key, "
        f"n AS t, 0 AS i, 0 AS a FROM {_TEXT} x UNION ALL SELECT key, 0, n, 0 FROM {_IMAGES} y UNION ALL SELECT key, 0, 0, n FROM {_ALT} z) GROUP BY key"
    ),
    "first_known": (
        f"SELECT key, nullif(arg_min(entity, i), -1) AS entity, arg_min(text, i) AS surface FROM (SELECT s.*, coalesce(d.entity, -1) AS entity FROM {_READ} s "
        f"LEFT JOIN (SELECT {detection._KEY.format('surface')} AS k, min(entity_id) AS entity FROM {values('dictionary')} d WHERE status = 'approved' "
        f"GROUP BY ALL) d ON d.k = {detection._KEY.format('text')} WHERE {_NOT_OWN} AND (d.entity IS NOT NULL OR regexp_matches(text, "
        f"'\\b([A-Z]{{2,}}-?\\d{{4,}}|\\d{{6,}})\\b'))) h GROUP BY key"
    ),
    "readable_fragments": (
        f"SELECT conv_id, count(*)::BIGINT AS n FROM {_SAID} s WHERE length(text) >= 2 AND NOT regexp_full_match(text, '\\d+') AND {_NOT_OWN} "
        f"AND {detection._KEY.format('text')} NOT IN (SELECT {detection._KEY.format('surface')} FROM {values('dictionary')} d WHERE status = 'skipped') "
        f"GROUP BY ALL"
    ),
    "placeholders": f"SELECT * FROM {_COVER} c",
    "residual_images": f"SELECT group_id, idx FROM ({review.ORACLE['redacted_images']}) r WHERE idx NOT IN (SELECT vec_id FROM {_COVER} c WHERE cover)",
    "fresh_hits": "SELECT page_id, url AS text FROM pages WHERE page_id % 5 > 2 AND NOT regexp_matches(url, '(?i)(^|[^A-Za-z0-9])(anon|firm)([^A-Za-z0-9]|$)')",
    "reidentifiable": "SELECT doc_id, doc_id % 10 / 10 AS confidence FROM documents WHERE doc_id % 10 >= 5",
    "precision_misses": (
        f"SELECT doc_id AS run_id, entity_type, count(*)::BIGINT AS n FROM ({detection._CAND}) c WHERE (doc_id, key) IN (SELECT doc_id, lower(upper(surface)) "
        f"FROM ({detection._CAND}) r WHERE doc_id % 3 = 0 AND length(surface) % 2 = 0) GROUP BY ALL"
    ),
    "visual_merge": f"SELECT * FROM {_MERGED} m",
    "own_firm_logos": f"SELECT vec_id FROM {images._H} a WHERE EXISTS (SELECT 1 FROM {images._H} b WHERE b.vec_id % 100 = 0 AND {images._D} <= {images.NEAR})",
    "entity_children": (
        f"SELECT n_name, array_to_string(a.l[1:{SHOWN_NAMES}], '|') AS aliases, r_name AS account, array_to_string(g.l[1:{SHOWN_LOGOS}], ',') AS logos "
        f"FROM nation LEFT JOIN (SELECT s_nationkey, list(s_name ORDER BY s_name) AS l FROM supplier GROUP BY ALL) a ON s_nationkey = n_nationkey LEFT "
        f"JOIN (SELECT vec_id % 30 AS k, list(vec_id ORDER BY vec_id DESC) AS l FROM embeddings GROUP BY ALL) g ON k = n_nationkey LEFT "
        f"JOIN region ON r_regionkey = n_regionkey"
    ),
    "tagging_source": f"SELECT user_id, event_id, c_name AS name FROM {governance._LATEST} l JOIN customer ON c_custkey = user_id WHERE status = 'completed'",
    "group_totals": (
        f"SELECT vec_id // 50 AS group_id, count(*)::BIGINT AS images, count(*) FILTER (identity)::BIGINT AS flagged, count(*) "
        f"FILTER (judgment)::BIGINT AS judgment FROM {images._RULES} r GROUP BY ALL"
    ),
    "skipped_clusters": (
        f"SELECT owner, least(n, {CAP})::BIGINT AS shown, greatest(n - {CAP}, 0)::BIGINT AS skipped FROM (SELECT owner, count(DISTINCT cluster) AS n "
        f"FROM ({images.ORACLE['greedy_clusters']}) c GROUP BY owner)"
    ),
    "thresholds_used": (
        f"SELECT doc_id, string_agg(t, ',' ORDER BY t) AS thresholds FROM (SELECT DISTINCT doc_id, printf('%.2f', threshold) AS t FROM {detection._GATED} g) "
        f"GROUP BY doc_id"
    ),
    "excerpts": f"SELECT doc_id, md5(substring(text, 1, {EXCERPT_CHARS})) AS digest FROM documents",
    "runs_newest": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events",
    "documents_newest": "SELECT doc_id, lang FROM documents WHERE source = 'src1'",
    "users_newest": "SELECT c_custkey, c_name FROM customer",
    "vocabulary_sorted": f"SELECT * FROM {governance.TERMS} v",
    "proposals": f"SELECT category, value FROM {_TERMS} t WHERE status = 'pending_approval'",
    "accounts_by_name": "SELECT n_name, n_regionkey FROM nation",
    "mask_maps": "SELECT c_custkey, CASE WHEN c_mktsegment < 'x' THEN c_mktsegment || '=new,x=old' ELSE 'x=old,' || c_mktsegment || '=new' END AS entries FROM customer",
    "scrub_titles": (
        f"SELECT page_id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title FROM (SELECT page_id, "
        f"{_replaced(_PLAIN_TITLE, lambda s, t: t)} AS t FROM pages)"
    ),
    "page_node_text": "SELECT page_id, md5(array_to_string(list_filter(regexp_extract_all(html, '>([^<>]+)<', 1), lambda t: trim(t, ' ') <> ''), ' ')) AS digest FROM pages",
}
QUERIES = {name: globals()[name] for name in ORACLE}
