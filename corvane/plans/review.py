"""Queries on review edits, markup clean-up and image follow-up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions.patterns import sign_hash, surface_regex
from corvane.operators import channels, detect, review, scrub, spans
from corvane.plans import governance, similarity
from corvane.plans.fixtures import OWN_FIRM, approved, literal, values
from corvane.plans.masking import _PAGE, _replaced
from corvane.sources.tables import table

FIELDS = ["title"]


def clear_identity_fields(spark, folder):
    xml = scrub.cleared_attributes(scrub.cleared_fields(F.col("html"), FIELDS), ["content"])
    return table(spark, folder, "pages").select("page_id", F.md5(xml).alias("digest"))


def scrub_hyperlinks(spark, folder):
    links = F.regexp_extract_all("html", F.lit(channels.HREF), F.lit(1))
    rows = table(spark, folder, "pages").select("page_id", F.explode(F.arrays_zip(links.alias("a"), scrub.scrubbed_items(links, approved()).alias("b"))).alias("x"))
    return rows.groupBy("page_id").agg(F.count_if(F.col("x.a") != F.col("x.b")).alias("changed"))


def brand_keys(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", scrub.brand_key(F.concat(F.lit("  "), F.replace("s_name", F.lit("#"), F.lit("  \n ")), F.lit(" "))).alias("brand"))


def phrase_places(spark, folder):
    phrases = spark.sql("SELECT * FROM VALUES ('of the'), ('the'), ('and the') AS t(phrase)")
    found = scrub.word_matches(table(spark, folder, "documents"), "doc_id", phrases)
    return found.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


def masked_runs(spark, folder):
    """Runs of nine characters, masked run by run, join to the masked text."""
    docs = table(spark, folder, "documents").where("text is not null")
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,9}"), F.lit(0))
    return docs.select("doc_id", F.array_join(spans.masked_pieces(pieces, approved()), "").alias("masked"))


def alt_text_ladder(spark, folder):
    """Page titles as alternative texts."""
    titles = channels.page_channels(table(spark, folder, "pages")).where("channel = 'metadata'").select("page_id", F.col("item").cast("long").alias("item"), "text")
    known = F.when(F.col("text").rlike(surface_regex("of the")), "of the").when(F.col("text").rlike(surface_regex("the")), "the")
    number = F.nullif(F.regexp_extract("text", r"\d{4,}", 0), F.lit(""))
    merged, skipped = F.when(F.col("page_id") % 9 == 0, "merged"), F.col("page_id") % 11 == 0
    return scrub.alt_text_entities(titles, detect.own_firm(F.col("text"), OWN_FIRM), known, number, merged, skipped).select("page_id", "item", "entity", "confidence")


def _merge_input(spark, folder):
    """A nation's suppliers are one run's entities, some twice; merges make chains both ways, cycles, misses and blanks."""
    rows = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("entity"), "s_name")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("entity"))
    rows = rows.withColumn("place", place.cast("long")).withColumn("kind", F.col("entity") % 6)
    entities = rows.select("run_id", "entity", "place", (F.col("place") * 2).alias("ord"), F.when(F.col("kind") == 3, F.upper("s_name")).otherwise(F.col("s_name")).alias("surface"))
    again = entities.where("entity % 5 = 0").select("run_id", (F.col("entity") + 1000000).alias("entity"), "place", (F.col("ord") + 1).alias("ord"), "surface")
    target = F.when(F.col("kind") == 1, F.col("place") - 1).when(F.col("kind") == 2, F.col("place") - 1).when(F.col("kind") == 4, F.col("place") + 1).when(F.col("kind") == 5, F.greatest(F.col("place") - 1, F.lit(1)))
    names = rows.select("run_id", F.col("place").alias("target"), F.concat(F.lit(" "), F.lower("s_name")).alias("canonical"))
    merges = rows.withColumn("target", target).where("kind in (1, 2, 4, 5)").join(names, ["run_id", "target"], "left")
    canonical = F.when(F.col("entity") % 9 == 4, " ").otherwise(F.coalesce("canonical", F.lit("nobody")))
    merges = merges.join(entities.select("run_id", "entity", "surface"), ["run_id", "entity"]).select("run_id", "surface", canonical.alias("canonical"))
    return entities.unionByName(again).select("run_id", "ord", "surface", "entity"), merges


def entity_merges(spark, folder):
    return review.merged_surfaces(*_merge_input(spark, folder)).select("run_id", "surface", "entity", "missed")


def merge_aliases(spark, folder):
    """What the merges add to the aliases; the first run's surfaces are aliases already."""
    entities, merges = _merge_input(spark, folder)
    return review.merge_aliases(review.merged_surfaces(entities, merges), entities.where("run_id = 0").select("surface"))


def run_mask_map(spark, folder):
    entities = literal(spark, "dictionary").groupBy("entity_id").agg(F.min_by("token", "alias_id").alias("token"))
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.struct(F.col("l_linenumber").isNull().alias("last"), "l_linenumber", "l_partkey").alias("occurrence_id"), F.when(F.col("l_partkey") % 2 == 0, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag")).alias("surface"), F.when(F.col("l_partkey") % 9 != 0, (F.col("l_partkey") % 9).cast("int")).alias("entity_id"))
    return review.run_map(rows, entities)


def _images(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.md5(F.col("vec_id").cast("string")).alias("digest"))


def redacted_images(spark, folder):
    groups = _images(spark, folder).groupBy(F.col("label").alias("group_id")).agg(F.sort_array(F.collect_list("idx")).alias("indices"), F.min("digest").alias("digest"))
    moved = groups.withColumn("indices", F.when(F.col("group_id") == 1, F.transform("indices", lambda i: i + 1000000)).otherwise(F.col("indices")))
    return review.approved_images(moved, _images(spark, folder))


def surviving_images(spark, folder):
    rows = _images(spark, folder)
    return review.surviving(rows.where("label = 2"), rows.where("idx % 3 = 0")).select("idx")


def _read_names(spark, folder):
    """Groups of images of one label, and what is read on them: a supplier's name in some case, or nothing; some match a stored token."""
    read = table(spark, folder, "supplier").select((F.col("s_suppkey") * 3).alias("group_id"), F.upper("s_name").alias("ocr"))
    token = F.when(F.col("group_id") % 2 == 0, F.format_string("[CLIENT_%d]", F.col("group_id") % 40))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("group_id")).join(read, "group_id", "left").withColumn("token", token)


def image_labels(spark, folder):
    return review.image_labels(_read_names(spark, folder), governance.dictionary(spark, folder), "Supplier#000000001")


def logo_attribution(spark, folder):
    return review.attributed(_read_names(spark, folder), governance.dictionary(spark, folder))


def approved_residuals(spark, folder):
    lists = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("list"))
    chosen = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 9).cast("int").alias("place"))
    return review.approved_residuals(lists, chosen).select("run_id", F.col("place").cast("long").alias("place"), "residual")


def resolved_flags(spark, folder):
    events = table(spark, folder, "events")
    flags = events.select(F.col("event_id").alias("flag_id"), F.col("user_id").alias("run_id"), F.concat(F.lit("left in "), F.element_at(F.array(*[F.lit(c) for c in ("Text", "metadata", "images")]), (F.col("event_id") % 3 + 1).cast("int"))).alias("message"), F.when(F.col("event_type") == "error", "blocking").otherwise("info").alias("severity"))
    clean = events.select(F.col("user_id").alias("run_id")).distinct().select("run_id", F.explode(F.array(F.struct(F.lit("text").alias("channel"), (F.col("run_id") % 2 == 0).alias("clean")), F.struct(F.lit("metadata").alias("channel"), F.lit(True).alias("clean")))).alias("x")).select("run_id", "x.*")
    return review.resolved_flags(flags, clean).groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def reviewed_tags(spark, folder):
    tags = table(spark, folder, "documents").select("doc_id", F.lit("technology").alias("category"), F.col("source").alias("value"))
    removed = spark.sql("SELECT 'technology' AS category, 'src1' AS value")
    decision = F.when(F.col("doc_id") % 3 == 0, "rejected").otherwise("approved")
    return review.applied_tags(tags, removed, literal(spark, "vocabulary"), decision).groupBy("value", "status").agg(F.count(F.lit(1)).alias("n"))


def residual_messages(spark, folder):
    rows = literal(spark, "verdicts").join(table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 10).cast("int").alias("label"), sign_hash(F.col("embedding")).alias("phash")), "label")
    message = scrub.residual_message(F.when(F.col("vec_id") % 2 == 0, " ").otherwise(F.col("phash")), F.col("ocr"), F.array(F.lit("a"), F.lit("b")))
    return rows.select("vec_id", message.alias("message"))


_WORDS = (
    r"list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), "
    r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
)
_D = values("dictionary")


def _phrase(phrase: str) -> str:
    words = phrase.split(" ")
    tests = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words[:-1])) or "true"
    last = f"ws[i + {len(words) - 1}]"
    return (
        f"SELECT doc_id, '{phrase}' AS phrase, count(*)::BIGINT AS n FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w) WHERE {tests} "
        f"AND ({last} IN ('{words[-1]}', '{words[-1]}''s', '{words[-1]}’s')) GROUP BY doc_id"
    )


_GROUPS = (
    "(SELECT vec_id AS group_id, upper(s_name) AS ocr, CASE WHEN vec_id % 2 = 0 THEN '[CLIENT_' || (vec_id % 40) || ']' END AS token FROM embeddings LEFT "
    "JOIN supplier ON vec_id = s_suppkey * 3)"
)
_NAME_KEY = r"regexp_replace(regexp_replace(trim(lower({}), ' '), '[^\w@.\s-]', '', 'g'), '\s+', ' ', 'g')"
#: The rule taken step by step: the surfaces of a run in order, with a map of what has been resolved so far.
_MERGES = """WITH RECURSIVE s AS (SELECT s_nationkey AS run_id, s_suppkey AS entity, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, s_suppkey % 6 AS kind FROM supplier),
one AS (SELECT *, CASE WHEN kind = 3 THEN upper(s_name) ELSE s_name END AS surface, CASE kind WHEN 1 THEN place - 1 WHEN 2 THEN place - 1 WHEN 4 THEN place + 1 WHEN 5 THEN greatest(place - 1, 1) END AS target FROM s),
e AS MATERIALIZED (SELECT run_id, place * 2 AS ord, surface, entity FROM one UNION ALL SELECT run_id, place * 2 + 1, surface, entity + 1000000 FROM one WHERE entity % 5 = 0),
m AS (SELECT a.run_id, a.surface, CASE WHEN a.entity % 9 = 4 THEN '' ELSE coalesce(lower(b.s_name), 'nobody') END AS canonical FROM one a LEFT JOIN one b ON b.run_id = a.run_id AND b.place = a.target WHERE a.kind IN (1, 2, 4, 5)),
q AS MATERIALIZED (SELECT e.*, nullif(m.canonical, '') AS canonical, row_number() OVER (PARTITION BY e.run_id ORDER BY nullif(m.canonical, '') IS NOT NULL, ord) AS p FROM e LEFT JOIN m USING (run_id, surface)),
walk(run_id, p, state, surface, entity, missed, merged) AS (
  SELECT run_id, 0::BIGINT, MAP([''], [-1::BIGINT]), '', -1::BIGINT, false, false FROM (SELECT DISTINCT run_id FROM q)
  UNION ALL
  SELECT run_id, p, map_concat(state, MAP([lower(surface)], [got])), surface, got, canonical IS NOT NULL AND found IS NULL, found IS NOT NULL FROM (
    SELECT w.run_id, q.p, w.state, q.surface, q.canonical, w.state[q.canonical] AS found, coalesce(w.state[q.canonical], q.entity) AS got FROM walk w JOIN q ON q.run_id = w.run_id AND q.p = w.p + 1)),
done AS (SELECT * FROM walk WHERE p > 0)"""

ORACLE = {
    "clear_identity_fields": r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)(<title(?: [^>]*)?>).*?(</title>)', '\1\2', 'g'), '\b((?:\w+:)?content=)"[^"]*"', '\1""', 'g')) AS digest FROM pages""",
    "scrub_hyperlinks": (
        f"SELECT page_id, count(*) FILTER (text <> {_replaced('text', lambda s, t: t)})::BIGINT AS changed FROM {_PAGE} p WHERE channel = 'hyperlinks' "
        f"GROUP BY page_id"
    ),
    "brand_keys": "SELECT s_suppkey, lower(trim(regexp_replace(replace(s_name, '#', '  ' || chr(10) || ' '), '\\s+', ' ', 'g'))) AS brand FROM supplier",
    "phrase_places": f"WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents) " + " UNION ALL ".join(map(_phrase, ("of the", "the", "and the"))),
    "masked_runs": f"SELECT doc_id, {_replaced('text', lambda s, t: t)} AS masked FROM documents WHERE text IS NOT NULL",
    "alt_text_ladder": f"""SELECT page_id, item::BIGINT AS item, CASE WHEN page_id % 9 = 0 THEN 'merged' WHEN a THEN 'of the' WHEN b THEN 'the' WHEN n <> '' THEN n ELSE trim(text, ' ') END AS entity, CASE WHEN page_id % 9 = 0 OR a OR b THEN 1.0 WHEN n <> '' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT *, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])of\\s+the([^A-Za-z0-9]|$)') AS a, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') AS b, regexp_extract(text, '\\d{{4,}}') AS n FROM {_PAGE} p WHERE channel = 'metadata' AND page_id % 11 <> 0 AND length(trim(text, ' ')) >= 2 AND NOT regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(anon|firm)([^A-Za-z0-9]|$)'))""",
    "entity_merges": f"{_MERGES} SELECT run_id, surface, arg_max(entity, p) AS entity, arg_max(missed, p) AS missed FROM done GROUP BY run_id, surface",
    "merge_aliases": (
        f"{_MERGES}, last AS (SELECT run_id, surface, arg_max(entity, p) AS entity, arg_max(merged, p) AS merged FROM done GROUP BY run_id, surface) "
        f"SELECT arg_min(entity, (surface, entity)) AS entity, min(surface) AS surface FROM (SELECT surface, entity, {_NAME_KEY.format('surface')} AS k "
        f"FROM last WHERE merged) n WHERE k NOT IN (SELECT {_NAME_KEY.format('surface')} FROM e WHERE run_id = 0) GROUP BY k"
    ),
    "run_mask_map": (
        f"SELECT run_id, surface, token FROM (SELECT l_orderkey AS run_id, CASE WHEN l_partkey % 2 = 0 THEN upper(l_returnflag) ELSE lower(l_returnflag) "
        f"END AS surface, l_partkey % 9 AS e FROM lineitem WHERE l_partkey % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(l_returnflag) "
        f"ORDER BY l_linenumber, l_partkey) = 1) o JOIN (SELECT entity_id, arg_min(token, alias_id) AS token FROM {_D} d GROUP BY entity_id) "
        f"t ON t.entity_id = o.e"
    ),
    "redacted_images": (
        "SELECT label AS group_id, vec_id AS idx FROM embeddings WHERE label <> 1 UNION ALL SELECT 1, arg_min(vec_id, md5(vec_id::VARCHAR)) FROM embeddings "
        "WHERE label = 1"
    ),
    "surviving_images": "SELECT vec_id AS idx FROM embeddings WHERE label = 2 AND vec_id % 3 = 0",
    "image_labels": (
        f"SELECT group_id, coalesce(nullif(d.custom, ''), (SELECT min(nullif(custom, '')) FROM {governance.DICTIONARY} c WHERE lower(surface) "
        f"= 'supplier#000000001')) AS label FROM {_GROUPS} g LEFT JOIN {governance.DICTIONARY} d ON lower(d.surface) = lower(g.ocr)"
    ),
    "logo_attribution": (
        f"SELECT group_id, entity_id FROM (SELECT group_id, coalesce(d.entity_id, t.entity_id) AS entity_id FROM {_GROUPS} g LEFT "
        f"JOIN {governance.DICTIONARY} d ON lower(d.surface) = lower(g.ocr) LEFT JOIN (SELECT token, min(entity_id) AS entity_id FROM {governance.DICTIONARY} x "
        f"GROUP BY token) t ON t.token = g.token) a WHERE entity_id IS NOT NULL"
    ),
    "approved_residuals": (
        "SELECT o_orderkey AS run_id, (o_custkey % 9)::BIGINT AS place, residual FROM orders JOIN (SELECT l_orderkey, l_partkey AS residual, row_number() "
        "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS p FROM lineitem) l ON l_orderkey = o_orderkey AND p = o_custkey % 9"
    ),
    "resolved_flags": (
        "SELECT user_id AS run_id, CASE WHEN event_type = 'error' THEN 'blocking' ELSE 'info' END AS severity, count(*)::BIGINT AS n FROM events "
        "WHERE NOT (event_type = 'error' AND (event_id % 3 = 1 OR (event_id % 3 = 0 AND user_id % 2 = 0))) GROUP BY ALL"
    ),
    "reviewed_tags": (
        "SELECT source AS value, CASE WHEN doc_id % 3 = 0 THEN 'applied' ELSE 'confirmed' END AS status, count(*)::BIGINT AS n FROM documents "
        "WHERE source IN ('src0', 'src2') GROUP BY ALL"
    ),
    "residual_messages": (
        f"SELECT e.vec_id, CASE WHEN e.vec_id % 2 <> 0 THEN h.phash ELSE coalesce(v.ocr, 'a, b') END AS message FROM embeddings e "
        f"JOIN {values('verdicts')} v ON v.label = e.vec_id % 10 JOIN (@PHASH@) h USING (vec_id)"
    ),
}
ORACLE["residual_messages"] = ORACLE["residual_messages"].replace("@PHASH@", similarity.ORACLE["phash_from_embedding"])
QUERIES = {name: globals()[name] for name in ORACLE}
