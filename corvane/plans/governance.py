"""Queries on the dictionary's upkeep, review, tags, access and run states."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import governance, lifecycle
from corvane.plans import detection
from corvane.plans.fixtures import literal, values
from corvane.sources.tables import table

NEW_KINDS = ("CLIENT_NAME", "CLIENT_PERSON", "CLIENT_EMAIL_DOMAIN", "OTHER")
TOKENS = ("[CLIENT_1]", "[CLIENT_3]", "[CLIENT_9]", "[CLIENT_10]", "[CLIENT_40]", "[CLIENT_PERSON_2]", "[CLIENT_PERSON_7]", "[CLIENT_DOMAIN_1]", "[CLIENT_DOMAIN_3]", "[CLIENT_DOMAIN_4]")


def token_allocation(spark, folder):
    """New surfaces of all kinds, numbered beside tokens whose numbers have gaps."""
    kinds = F.array(*[F.lit(x) for x in NEW_KINDS])
    new = detection.pii_candidates(spark, folder).groupBy("key").agg(F.min("surface").alias("surface"))
    typed = new.select("surface", F.element_at(kinds, (F.length("surface") % len(NEW_KINDS) + 1).cast("int")).alias("entity_type"))
    return governance.allocated_tokens(typed, spark.createDataFrame([(t,) for t in TOKENS], "token string")).select("surface", "entity_type", "token")


def alias_collision(spark, folder):
    proposed = table(spark, folder, "nation").select(F.col("n_nationkey").alias("entity_id"), F.concat(F.lit("Group of the "), F.col("n_name")).alias("replacement"))
    own = proposed.unionByName(spark.sql("SELECT 9 AS entity_id, 'partner' AS replacement"))
    return governance.alias_collisions(own, literal(spark, "dictionary"))


def snapshot_upsert(spark, folder):
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"), F.lit(1).alias("version"))
    changed = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("state")).withColumn("version", F.lit(2))
    return governance.upserted(old, changed, ["id"], "version")


def snapshot_insert(spark, folder):
    old = literal(spark, "vocabulary")
    new = table(spark, folder, "documents").select(F.lit("technology").alias("category"), F.col("source").alias("value"), F.lit("pending_approval").alias("status")).distinct()
    return governance.inserted(old, new, ["category", "value"])


def _words(spark, folder):
    words = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    return table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("run_id"), F.posexplode(words).alias("ord", "surface"))


def _proposed(spark, folder):
    """Each document's different words of four letters or more."""
    words = F.array_distinct(F.filter(F.split("text", "[ \n]+"), lambda x: F.length(x) > 3))
    return table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("run_id"), F.explode(words).alias("surface"))


def review_removals(spark, folder):
    """What stays of every document's words of four letters or more; reviewers of bad documents remove the longer ones."""
    bad = table(spark, folder, "labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("run_id"))
    removed = bad.join(_proposed(spark, folder), "run_id").where("length(surface) > 5").select("run_id", F.upper("surface").alias("surface"))
    return governance.review_removals(_proposed(spark, folder), removed).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def review_additions(spark, folder):
    """Reviewers add every word of the text; those that were proposed do not count again."""
    return governance.review_additions(_proposed(spark, folder), _words(spark, folder)).select("run_id", "surface")


def review_deltas(spark, folder):
    flagged = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("entity_type"), F.coalesce(F.length("text") < 400, F.lit(True)).alias("flag"))
    both = flagged.join(table(spark, folder, "labels"), "doc_id")
    return governance.review_deltas(both.where("not flag and quality = 0"), both.where("flag and quality = 1"))


def review_delta_totals(spark, folder):
    """Every document is a run; those whose label says that the flag was wrong have data."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("run_id"), F.coalesce(F.length("text") < 400, F.lit(True)).alias("flag"))
    both = docs.join(table(spark, folder, "labels").select(F.col("doc_id").alias("run_id"), "quality"), "run_id")
    return governance.review_delta_totals(docs, both.where("not flag and quality = 0"), both.where("flag and quality = 1"))


def tag_gate(spark, folder):
    docs = table(spark, folder, "documents")
    confidence = (F.col("doc_id") % 10) / 10
    domain = docs.select("doc_id", F.lit("domain").alias("category"), F.upper("lang").alias("value"), confidence.alias("confidence"))
    source = docs.select("doc_id", F.lit("technology").alias("category"), F.concat(F.lit(" "), F.col("source")).alias("value"), confidence.alias("confidence"))
    return governance.tag_gate(domain.unionByName(source), literal(spark, "vocabulary")).groupBy("category", "value", "status").agg(F.count(F.lit(1)).alias("n"))


def terms(spark, folder):
    """A vocabulary of the tables' own terms: languages, sources, nations, part types and market segments; some wait for approval."""
    docs, kinds = table(spark, folder, "documents"), []
    for category, rows, column in (("domain", docs, "lang"), ("technology", docs, "source"), ("geography", table(spark, folder, "nation"), "n_name"), ("engagement_type", table(spark, folder, "part"), "p_type")):
        kinds.append(rows.where(F.col(column).isNotNull()).select(F.lit(category).alias("category"), F.lower(column).alias("value")).distinct())
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    return every.withColumn("status", F.when(F.length("value") % 3 == 0, "pending_approval").otherwise("approved"))


def vocabulary_by_category(spark, folder):
    """Approved terms of each category, all five of them."""
    own = terms(spark, folder).where("status = 'approved'").groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("terms"))
    return literal(spark, "categories").join(own, "category", "left").select("ord", "category", F.coalesce("terms", F.lit("")).alias("terms"))


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "value", lifecycle.status_of(F.col("event_type")).alias("status"))


def run_status_latest(spark, folder):
    return lifecycle.latest(_events(spark, folder), "user_id", ["ts", "event_id"], "status", "event_id")


def stale_runs(spark, folder):
    runs = lifecycle.latest(_events(spark, folder).withColumn("updated_at", F.col("ts")), "user_id", ["ts", "event_id"], "status", "updated_at")
    now = F.lit(table(spark, folder, "events").agg(F.max("ts").alias("ts")).first()["ts"])
    return lifecycle.stale(runs, now).select("user_id", "status")


def fifo_head(spark, folder):
    return lifecycle.oldest(_events(spark, folder), "pending", ["ts", "event_id"]).select("event_id", "user_id")


def run_kpis(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.length("props").alias("tokens_in"), F.when(F.col("event_type") != "error", F.floor("value")).alias("tokens_out"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens_in").cast("long").alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).cast("long").alias("tokens_out"), F.round(F.sum(lifecycle.cost(F.col("tokens_in"), F.col("tokens_out"))), 4).alias("cost"))


def any_blocking_status(spark, folder):
    flags = table(spark, folder, "events").select("user_id", F.when(F.col("event_type") == "error", "blocking").when(F.col("event_type") == "click", "warning").otherwise("info").alias("severity"))
    return lifecycle.final_status(flags, "user_id")


def _people(spark, folder):
    roles = F.element_at(F.array(*[F.lit(r) for r in ("admin", "km_governance", "km_reviewer", "practice_lead", "delivery", "read_only")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey", roles.alias("role"))


def rbac_visibility(spark, folder):
    """Runs that each reviewer sees: their own, and all of their nation if they may manage the queue."""
    people = _people(spark, folder)
    managers = governance.allowed(people, literal(spark, "capabilities"), "review_queue_manage").select("user_id")
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("own"))
    total = table(spark, folder, "orders").count()
    seen = people.join(orders, "user_id", "left").join(managers.withColumn("manages", F.lit(True)), "user_id", "left")
    return seen.select("user_id", "role", F.when(F.col("manages"), F.lit(total)).otherwise(F.coalesce("own", F.lit(0))).alias("visible"))


def separation_of_duty(spark, folder):
    people = _people(spark, folder).select("user_id", "role")
    reviews = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("creator"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("user_id"))
    return reviews.join(people, "user_id").where((F.col("creator") != F.col("user_id")) | (F.col("role") == "admin")).select("o_orderkey", F.col("user_id").alias("reviewer"))


def accounts_with_owners(spark, folder):
    owners = table(spark, folder, "supplier").where("s_suppkey % 2 = 0").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("owners"))
    nations = table(spark, folder, "nation")
    return nations.join(owners, nations["n_nationkey"] == owners["s_nationkey"], "left").select("n_name", F.coalesce("owners", F.lit("")).alias("owners"))


def practice_leads(spark, folder):
    return _people(spark, folder).where("role = 'practice_lead'").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("user_id", "n_name")


def dictionary(spark, folder):
    """A dictionary of nations, their suppliers being their aliases: entity_id, alias_id, surface, token, status, created_days, custom."""
    rows = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.col("s_suppkey").alias("alias_id"), F.col("s_name").alias("surface"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending_approval", "approved", "skipped")]), (F.col("entity_id") % 3 + 1).cast("int"))
    custom = F.when(F.col("entity_id") % 4 == 1, F.concat(F.lit("Partner "), "entity_id")).when(F.col("entity_id") % 4 == 2, F.lit(""))
    return rows.select("*", F.format_string("[CLIENT_%d]", F.col("entity_id") + 1).alias("token"), status.alias("status"), (F.col("entity_id") * 2 % 31).alias("created_days"), custom.alias("custom"))


def dictionary_view(spark, folder):
    """Each entity with its aliases, what stands for it, and whether it has waited too long; the newest first."""
    rows = dictionary(spark, folder)
    first = lambda c: F.min_by(c, "alias_id").alias(c)
    surfaces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alias_id", "surface"))), lambda x: x["surface"]), "|")
    names = rows.groupBy("entity_id").agg(surfaces.alias("surfaces"), first("token"), first("status"), F.min("custom").alias("custom"), F.max("created_days").alias("age"))
    old = (F.col("status") == "pending_approval") & (F.col("age") > governance.STALE_DAYS)
    return names.select("entity_id", "surfaces", F.coalesce(F.nullif("custom", F.lit("")), "token").alias("replacement"), "status", old.alias("stale"), "age").orderBy("age", "entity_id")


def audit_feed(spark, folder):
    events = table(spark, folder, "events").withColumn("action", F.concat(F.when(F.col("event_type") == "signup", "role_changed:").otherwise("run_"), F.col("event_type")))
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("actor"))
    return events.where(F.col("action").like("role_changed:%")).join(people, "user_id", "left").select("event_id", "action", "actor")


def review_queue(spark, folder):
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("creator"))
    return table(spark, folder, "orders").where("o_orderstatus = 'P'").join(people, "o_custkey", "left").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "creator", "o_totalprice")


def run_detail_children(spark, folder):
    """Both child lists are aggregated before they are joined, so neither multiplies the other."""
    items = table(spark, folder, "lineitem")
    steps = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("steps"))
    flags = items.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("flags"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return orders.join(steps, "l_orderkey", "left").join(flags, "l_orderkey", "left").select(F.col("l_orderkey").alias("run_id"), "o_orderstatus", F.coalesce("steps", F.lit("")).alias("steps"), F.coalesce("flags", F.lit(0).cast("long")).alias("flags"))


def conversation_last_json(spark, folder):
    turns = table(spark, folder, "conversations")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))
    reply = F.concat(F.lit('schema ```json {"a": 1} ``` answer ```json {"turn": '), F.col("turn").cast("string"), F.lit("} ```"))
    glued = F.concat(F.lit('echo {"schema": {"turn": 0}}, "turn": '), F.col("turn").cast("string"), F.lit("} end"))
    reply = F.when(F.col("conv_id") % 3 == 1, glued).otherwise(reply)
    return last.select("conv_id", F.get_json_object(lifecycle.last_json(reply), "$.turn").cast("long").alias("turn"), F.length("text").cast("long").alias("n_chars"))


def auto_chain(spark, folder):
    orders = table(spark, folder, "orders")
    first = orders.select(F.col("o_orderkey").alias("run_id"), F.lit("sanitization").alias("agent"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("detecting").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "tagging").alias("chain_to"), F.lit(None).cast("long").alias("parent"))
    done = orders.where("o_orderkey % 10 = 0").select((-F.col("o_orderkey")).alias("run_id"), F.lit("tagging").alias("agent"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("chain_to"), F.col("o_orderkey").alias("parent"))
    return lifecycle.chained(first.unionByName(done))


_STATUS = (
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'detecting' WHEN 'click' THEN 'awaiting_review' WHEN 'purchase' THEN 'completed' "
    "ELSE 'failed' END"
)
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')"
_PROPOSED = f"(SELECT DISTINCT doc_id AS run_id, unnest(list_filter({_WORDS}, lambda x: length(x) > 3)) AS surface FROM documents)"
_LATEST = (
    f"(SELECT user_id, arg_max({_STATUS}, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS updated_at FROM events "
    f"GROUP BY user_id)"
)
_PEOPLE = (
    "(SELECT c_custkey AS user_id, c_nationkey, ['admin', 'km_governance', 'km_reviewer', 'practice_lead', 'delivery', "
    "'read_only'][c_custkey % 6 + 1] AS role FROM customer)"
)
_ALIKE = "(?i)(^|[^A-Za-z0-9])"


def allocated(rows: str, tokens: str) -> str:
    """SQL of (surface, entity_type, token) for rows (surface, kind, p): one insert after another, with all tokens so far in a list."""
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY surface) AS i FROM ({rows}) x),
r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS surface, NULL::VARCHAR AS kind, {tokens}::VARCHAR[] AS tokens
UNION ALL SELECT c.i, c.surface, c.kind, list_append(r.tokens, '[' || c.p || '_' || list_filter(generate_series(
  len(list_filter(r.tokens, lambda t: t LIKE '[' || c.p || '_%]')) + 1, 2 * len(r.tokens) + 100), lambda k: NOT list_contains(r.tokens, '[' || c.p || '_' || k || ']'))[1] || ']')
FROM r JOIN c ON c.i = r.i + 1)
SELECT surface, kind AS entity_type, tokens[-1] AS token FROM r WHERE i > 0"""


PREFIX_OF = (
    "CASE kind WHEN 'CLIENT_PERSON' THEN 'CLIENT_PERSON' WHEN 'CLIENT_EMAIL_DOMAIN' THEN 'CLIENT_DOMAIN' WHEN 'CLIENT_CONTRACT_ID' THEN 'CLIENT_CONTRACT' "
    "ELSE 'CLIENT' END AS p"
)
_ALLOCATED = allocated(f"SELECT *, {PREFIX_OF} FROM (SELECT min(surface) AS surface, {list(NEW_KINDS)}[length(min(surface)) % 4 + 1] AS kind FROM ({detection._CAND}) GROUP BY key)", str(list(TOKENS)))

#: The dictionary key of any value: accents folded, then punctuation gone and white space as one space.
_FULL_KEY = r"regexp_replace(regexp_replace(trim(strip_accents(lower({})), ' '), '[^\p{{L}}\p{{N}}_@.\s-]', '', 'g'), '\s+', ' ', 'g')"
TERMS = (
    "(SELECT *, CASE WHEN length(value) % 3 = 0 THEN 'pending_approval' ELSE 'approved' END AS status FROM (SELECT DISTINCT 'domain' AS category, "
    "lower(lang) AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT 'technology', lower(source) FROM documents "
    "WHERE source IS NOT NULL UNION ALL SELECT DISTINCT 'geography', lower(n_name) FROM nation UNION ALL SELECT DISTINCT 'engagement_type', lower(p_type) "
    "FROM part))"
)
DICTIONARY = (
    "(SELECT s_nationkey AS entity_id, s_suppkey AS alias_id, s_name AS surface, '[CLIENT_' || (s_nationkey + 1) || ']' AS token, ['pending_approval', "
    "'approved', 'skipped'][s_nationkey % 3 + 1] AS status, s_nationkey * 2 % 31 AS created_days, CASE s_nationkey % 4 "
    "WHEN 1 THEN 'Partner ' || s_nationkey WHEN 2 THEN '' END AS custom FROM supplier)"
)
ORACLE = {
    "token_allocation": _ALLOCATED,
    "alias_collision": (
        f"SELECT DISTINCT p.entity_id, replacement, d.entity_id AS other_id, 'names' AS reason FROM (SELECT n_nationkey AS entity_id, "
        f"'Group of the ' || n_name AS replacement FROM nation) p JOIN {values('dictionary')} d ON d.entity_id <> p.entity_id AND length(surface) >= 3 "
        f"AND regexp_matches(replacement, '{_ALIKE}' || replace(surface, ' ', '\\s+') || '([^A-Za-z0-9]|$)') UNION ALL SELECT 9, 'partner', 2, 'repeats'"
    ),
    "snapshot_upsert": (
        "SELECT c_custkey AS id, coalesce(o.state, c_mktsegment) AS state, CASE WHEN o.state IS NULL THEN 1 ELSE 2 END AS version FROM customer LEFT "
        "JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"
    ),
    "snapshot_insert": (
        f"SELECT category, value, status FROM {values('vocabulary')} v UNION ALL SELECT DISTINCT 'technology', source, 'pending_approval' FROM documents "
        f"WHERE source NOT IN (SELECT value FROM {values('vocabulary')} v WHERE category = 'technology')"
    ),
    "review_removals": (
        f"SELECT run_id, count(*)::BIGINT AS n FROM {_PROPOSED} p WHERE (run_id, lower(surface)) NOT IN (SELECT run_id, lower(surface) FROM {_PROPOSED} q "
        f"JOIN labels l ON l.doc_id = q.run_id WHERE (toxic = 1 OR quality = 0) AND length(surface) > 5) GROUP BY run_id"
    ),
    "review_additions": (
        f"SELECT run_id, arg_min(surface, i) AS surface FROM (SELECT doc_id AS run_id, unnest(w) AS surface, generate_subscripts(w, 1) AS i "
        f"FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) a WHERE (run_id, {_FULL_KEY.format('surface')}) NOT IN (SELECT run_id, "
        f"{_FULL_KEY.format('surface')} FROM {_PROPOSED} p) GROUP BY run_id, {_FULL_KEY.format('surface')}"
    ),
    "review_delta_totals": (
        "SELECT count(DISTINCT d.doc_id)::BIGINT AS total_runs_checked, count(DISTINCT CASE WHEN (coalesce(length(text) < 400, true) AND quality = 1) "
        "OR (NOT coalesce(length(text) < 400, true) AND quality = 0) THEN d.doc_id END)::BIGINT AS runs_with_data FROM documents d LEFT "
        "JOIN labels l ON l.doc_id = d.doc_id"
    ),
    "review_deltas": (
        "SELECT lang AS entity_type, coalesce(sum((length(text) >= 400 AND quality = 0)::INT), 0)::BIGINT AS recall_misses, coalesce(sum((length(text) < 400 "
        "AND quality = 1)::INT), 0)::BIGINT AS precision_misses FROM documents JOIN labels USING (doc_id) GROUP BY lang "
        "HAVING recall_misses + precision_misses > 0"
    ),
    "tag_gate": (
        f"SELECT category, value, CASE WHEN v.status IS NULL THEN 'proposed_new' WHEN confidence >= 0.7::DOUBLE THEN 'applied' ELSE 'flagged' END AS status, "
        f"count(*)::BIGINT AS n FROM (SELECT 'domain' AS category, lang AS value, (doc_id % 10) / 10 AS confidence FROM documents UNION ALL "
        f"SELECT 'technology', source, (doc_id % 10) / 10 FROM documents) t LEFT JOIN (SELECT * FROM {values('vocabulary')} x WHERE status = 'approved') "
        f"v USING (category, value) GROUP BY ALL"
    ),
    "vocabulary_by_category": (
        f"SELECT ord, c.category, coalesce(string_agg(value, ',' ORDER BY value), '') AS terms FROM {values('categories')} c LEFT "
        f"JOIN {TERMS} v ON v.category = c.category AND v.status = 'approved' GROUP BY ALL"
    ),
    "run_status_latest": f"SELECT user_id, status, event_id FROM {_LATEST} l",
    "stale_runs": (
        f"SELECT user_id, status FROM {_LATEST} l WHERE status NOT IN ('pending', 'awaiting_review', 'completed', 'completed_with_issues', 'failed', "
        f"'rejected') AND updated_at < (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE"
    ),
    "fifo_head": "SELECT event_id, user_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 1",
    "run_kpis": (
        "SELECT user_id, count(*)::BIGINT AS runs, sum(length(props))::BIGINT AS tokens_in, sum(CASE WHEN event_type <> 'error' THEN floor(value) "
        "ELSE 0 END)::BIGINT AS tokens_out, round(sum(round(length(props) / 1000 * 0.003::DOUBLE + CASE WHEN event_type <> 'error' THEN floor(value) "
        "ELSE 0 END / 1000 * 0.015::DOUBLE, 6)), 4)::DOUBLE AS cost FROM events GROUP BY user_id"
    ),
    "any_blocking_status": "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'completed_with_issues' ELSE 'completed' END AS status FROM events GROUP BY user_id",
    "rbac_visibility": (
        f"SELECT user_id, role, CASE WHEN role IN ('admin', 'km_governance', 'km_reviewer') THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) "
        f"FROM orders WHERE o_custkey = user_id) END::BIGINT AS visible FROM {_PEOPLE} p"
    ),
    "separation_of_duty": (
        f"SELECT o_orderkey, user_id AS reviewer FROM (SELECT o_orderkey, o_custkey AS creator, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey "
        f"ELSE o_custkey + 1 END AS user_id FROM orders) o JOIN {_PEOPLE} p USING (user_id) WHERE creator <> user_id OR role = 'admin'"
    ),
    "accounts_with_owners": (
        "SELECT n_name, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS owners FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey "
        "AND s_suppkey % 2 = 0 GROUP BY n_name"
    ),
    "practice_leads": f"SELECT user_id, n_name FROM {_PEOPLE} p JOIN nation ON n_nationkey = c_nationkey WHERE role = 'practice_lead'",
    "dictionary_view": (
        f"SELECT entity_id, string_agg(surface, '|' ORDER BY alias_id) AS surfaces, coalesce(nullif(min(custom), ''), any_value(token)) AS replacement, "
        f"any_value(status) AS status, any_value(status) = 'pending_approval' AND max(created_days) > 14 AS stale, max(created_days) AS age FROM {DICTIONARY} d "
        f"GROUP BY entity_id"
    ),
    "audit_feed": "SELECT event_id, 'role_changed:signup' AS action, c_name AS actor FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'signup'",
    "review_queue": "SELECT o_orderkey, c_name AS creator, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'",
    "run_detail_children": (
        "SELECT o_orderkey AS run_id, o_orderstatus, coalesce(s.steps, '') AS steps, coalesce(s.flags, 0)::BIGINT AS flags FROM orders LEFT "
        "JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS steps, sum((l_returnflag = 'R')::INT) AS flags "
        "FROM lineitem GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey"
    ),
    "conversation_last_json": "SELECT conv_id, max(turn) AS turn, length(arg_max(text, turn))::BIGINT AS n_chars FROM conversations GROUP BY conv_id",
    "auto_chain": (
        "SELECT o_orderkey AS parent, 'tagging' AS agent, 'pending' AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 "
        "AND o_orderkey % 10 <> 0"
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE}
