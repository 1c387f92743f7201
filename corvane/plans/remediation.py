"""Remediation over the given tables: a page is a run's masked file, vectors are its images, events its flags and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import channels, remediation
from corvane.plans.masking import _PAGE
from corvane.sources.shared import new_folder
from corvane.sources.snapshots import Snapshots
from corvane.sources.tables import table

#: (surface, token): one token holds another surface, so body text masked with both still shows it.
NAMES = [("of the", "[CLIENT_2]"), ("and", "[the CLIENT]"), ("the", "[CLIENT_1]")]
STYLES = ("token", "black", "remove")
MESSAGES = ("Verification failed (text): before", "Verification failed (images): before", "3 images appear to reveal the client", "low confidence", "Verification failed (metadata): before")


def _runs(spark, folder):
    run = F.col("page_id")
    rows = table(spark, folder, "pages").select(
        run.alias("run_id"), F.when(run % 17 == 0, "tagging").otherwise("sanitization").alias("agent"), F.when(run % 5 == 0, "completed").otherwise("completed_with_issues").alias("status"),
        (run % 13 != 0).alias("has_file"), F.element_at(F.array(*map(F.lit, STYLES)), (run % 3 + 1).cast("int")).alias("style"), (run % 4).alias("images_redacted"),
    )
    return rows.withColumns({"verified": F.lit(False), **{f"verified_{c}": F.lit(None).cast("boolean") for c in remediation.CHANNELS}})


def _inputs(spark, folder):
    runs = _runs(spark, folder)
    items = channels.page_channels(table(spark, folder, "pages")).select(F.col("page_id").alias("run_id"), "channel", F.col("item").cast("long").alias("item"), "text")
    vectors = table(spark, folder, "embeddings").select((F.col("vec_id") % 100).alias("run_id"), F.floor(F.col("vec_id") / 100).alias("idx"), "vec_id", "label")
    images = vectors.select("run_id", "idx", F.md5(F.col("label").cast("string")).alias("digest"), (F.col("label") == 9).alias("cover"), (F.col("vec_id") % 7 != 0).alias("locatable"))
    grouped = lambda rows: rows.groupBy("run_id", F.col("label").alias("group_id")).agg(F.sort_array(F.collect_list("idx")).alias("indices"))
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(s).alias("surface"), F.lit(t).alias("token")) for i, (s, t) in enumerate(NAMES)])
    mask_map = runs.select("run_id", F.inline(names)).where((F.col("run_id") + F.col("ord")) % 4 != 0)
    events = table(spark, folder, "events")
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 5 + 1).cast("int"))
    return {
        "runs": runs, "items": items, "images": images, "mask_map": mask_map,
        "groups": grouped(vectors.where("label in (2, 4) and vec_id % 3 = 0 and run_id % 4 <> 1")), "fresh_groups": grouped(vectors.where("label in (2, 3)")),
        "flags": events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "blocking").otherwise("info").alias("severity"), message.alias("message")),
        "steps": events.where("event_type = 'view'").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step_order"), F.lit("detect").alias("name"), F.col("props").alias("detail")),
        "tagging": runs.where("run_id % 9 = 0").select("run_id"),
    }


def _requests(spark, folder):
    """Every other run, and some that do not exist."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("run_id"))
    return pages.where("run_id % 2 = 0").unionByName(pages.where("run_id % 50 = 0").select((F.col("run_id") + 1000000).alias("run_id")))


def _after(name):
    def query(spark, folder):
        return remediation.remediate(_inputs(spark, folder), _requests(spark, folder))[name]

    return query


def remediated_items(spark, folder):
    return _after("items")(spark, folder).select("run_id", "channel", "item", F.md5("text").alias("digest"))


def remediated_runs(spark, folder):
    """Through versions: the tables are committed, remediated as one further version, and read from that."""
    store = Snapshots(spark, new_folder(spark, "remediation"))
    store.commit(_inputs(spark, folder), -1)
    remediation.remediate_snapshot(store, _requests(spark, folder))
    return store.tables()["runs"]


def remediation_refused(spark, folder):
    return remediation.refused(_requests(spark, folder), _runs(spark, folder))


remediated_images, remediated_groups, remediated_flags, remediated_steps, remediated_tagging = map(_after, ("images", "groups", "flags", "steps", "tagging"))

#: Names that reviewers approve later; the last one is masked already, the third is blank.
LATER = [("is", "[CLIENT_5]"), ("on", "[CLIENT_6]"), (" ", "[CLIENT_7]"), ("the", "[CLIENT_1]")]


def _reapplied(name):
    def query(spark, folder):
        """Every third run gets further names; some texts end in what is left of a name."""
        tables = _inputs(spark, folder)
        rest = F.when((F.col("channel") == "text") & (F.col("run_id") % 7 == 1), F.concat("text", F.lit(" [CLIENT_5] Turbine Ltd. and"))).otherwise(F.col("text"))
        names = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(s).alias("surface"), F.lit(t).alias("token")) for i, (s, t) in enumerate(LATER)])
        approved = tables["runs"].where("run_id % 3 = 0").select("run_id", F.inline(names))
        return remediation.reapply(tables | {"items": tables["items"].withColumn("text", rest)}, approved)[name]

    return query


reapplied_summary = _reapplied("revalidations")


def reapplied_occurrences(spark, folder):
    return _reapplied("occurrences")(spark, folder).groupBy("run_id", F.lower("surface").alias("surface")).agg(F.count(F.lit(1)).alias("n"))


_DOUBLE = r"regexp_replace({}, '([^A-Za-z0-9])', '\1\1', 'g')"


def _hit(text: str, surface: str) -> str:
    return f"regexp_matches({_DOUBLE.format(text)}, '(?i)(^|[^A-Za-z0-9]){surface.replace(' ', chr(92) + 's+')}([^A-Za-z0-9]|$)')"


def _replace(text: str, surface: str, to: str) -> str:
    """Twice, as neighbours share a delimiter."""
    body = surface.replace(" ", r"\s+")
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^A-Za-z0-9]){body}([^A-Za-z0-9]|$)', '\\1' || {to} || '\\2', 'gi')"
    return text


def _by_style(surface: str, token: str) -> str:
    return f"CASE style WHEN 'remove' THEN '' WHEN 'black' THEN '{'█' * max(len(surface), 3)}' ELSE '{token}' END"


_KEEPS = [f"(run_id + {i}) % 4 <> 0" for i in range(len(NAMES))]
# Each step reads the column of the step before: one after the other, longest first, for links, comments and metadata …
_CHAIN = "it AS MATERIALIZED (SELECT *, text AS s0, text AS b0 FROM w)"
for _i, (_s, _t) in enumerate(NAMES):
    # … and with marks that no surface is in, turned into tokens at the end, for body text.
    _CHAIN += f", it{_i + 1} AS MATERIALIZED (SELECT *, CASE WHEN {_KEEPS[_i]} THEN {_replace(f's{_i}', _s, _by_style(_s, _t))} ELSE s{_i} END AS s{_i + 1}, CASE WHEN {_KEEPS[_i]} THEN {_replace(f'b{_i}', _s, chr(39) + f'##{_i}##' + chr(39))} ELSE b{_i} END AS b{_i + 1} FROM it{_i or ''})"
_BODY = f"b{len(NAMES)}"
for _i, (_s, _t) in enumerate(NAMES):
    _BODY = f"replace({_BODY}, '##{_i}##', {_by_style(_s, _t)})"
_LISTED = lambda text: "list_sort(list_filter([" + ", ".join(f"CASE WHEN {k} AND {_hit(text, s)} THEN '{s}' END" for k, (s, _) in zip(_KEEPS, NAMES)) + "], lambda x: x IS NOT NULL))"
_UNION = "list_sort(list_distinct(coalesce(flatten(list({})), [])))"
_WORK = "run_id % 17 <> 0 AND run_id % 5 <> 0 AND run_id % 13 <> 0 AND run_id % 2 = 0"
_SQL = f"""WITH pg AS MATERIALIZED (SELECT page_id AS run_id, channel, item::BIGINT AS item, text, ['token', 'black', 'remove'][page_id % 3 + 1] AS style FROM {_PAGE} p),
w AS (SELECT * FROM pg WHERE {_WORK}), {_CHAIN},
done AS MATERIALIZED (SELECT run_id, channel, item, text AS before, CASE WHEN channel = 'text' THEN {_BODY} ELSE s{len(NAMES)} END AS text, {_LISTED('text')} AS had FROM it{len(NAMES)}),
finds AS MATERIALIZED (SELECT *, {_LISTED('text')} AS lefts FROM done),
v AS MATERIALIZED (SELECT vec_id % 100 AS run_id, vec_id // 100 AS idx, vec_id, label, md5(label::VARCHAR) AS digest, label = 9 AS cover, vec_id % 7 <> 0 AS locatable FROM embeddings),
stored AS MATERIALIZED (SELECT * FROM v WHERE label IN (2, 4) AND vec_id % 3 = 0 AND run_id % 4 <> 1),
known AS MATERIALIZED (SELECT page_id AS run_id FROM pages),
wanted AS MATERIALIZED (SELECT DISTINCT run_id, idx FROM (SELECT run_id, idx FROM stored UNION ALL SELECT run_id, idx FROM v WHERE label IN (2, 3) AND run_id NOT IN (SELECT run_id FROM stored)) x WHERE {_WORK} AND run_id IN (SELECT run_id FROM known)),
pics AS MATERIALIZED (SELECT v.*, w.idx IS NOT NULL AND NOT cover AS targeted FROM v LEFT JOIN wanted w USING (run_id, idx) WHERE {_WORK} AND v.run_id IN (SELECT run_id FROM known)),
shot AS MATERIALIZED (SELECT p.*, targeted AND locatable AS swapped, digest IN (SELECT digest FROM pics q WHERE q.run_id = p.run_id AND q.targeted) AND NOT (targeted AND locatable) AS surviving FROM pics p),
i AS (SELECT run_id, count(*) FILTER (targeted) AS targets, count(*) FILTER (swapped) AS redacted, count(*) FILTER (surviving) AS surviving, count(*) FILTER (targeted AND NOT locatable) AS unlocated FROM shot GROUP BY run_id),
t AS (SELECT run_id, {', '.join(f"{_UNION.format('CASE WHEN channel = ' + chr(39) + c + chr(39) + ' THEN lefts END')} AS left_{c}" for c in remediation.CHANNELS if c != 'images')}, {_UNION.format("CASE WHEN channel = 'text' THEN had END")} AS had_text, {', '.join(f"count(*) FILTER (channel = '{c}' AND text IS DISTINCT FROM before) AS fixed_{c}" for c in remediation.SCRUBBED)} FROM finds GROUP BY run_id),
o AS MATERIALIZED (SELECT k.run_id, coalesce(targets, 0) AS targets, coalesce(redacted, 0) AS redacted, coalesce(i.surviving, 0) AS surviving, coalesce(unlocated, 0) AS unlocated, (SELECT count(DISTINCT label) FROM stored s WHERE s.run_id = k.run_id) AS stored, t.* EXCLUDE (run_id),
  {', '.join(f'len(left_{c}) = 0 AS clean_{c}' for c in remediation.CHANNELS if c != 'images')}, coalesce(i.surviving, 0) = 0 AND coalesce(unlocated, 0) = 0 AS clean_images FROM known k LEFT JOIN t USING (run_id) LEFT JOIN i USING (run_id) WHERE {_WORK}),
r AS MATERIALIZED (SELECT *, {' AND '.join(f'clean_{c}' for c in remediation.CHANNELS)} AS clean FROM o),
f AS MATERIALIZED (SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'blocking' ELSE 'info' END AS severity, ['{"', '".join(MESSAGES)}'][event_id % 5 + 1] AS message FROM events),
s AS MATERIALIZED (SELECT user_id AS run_id, event_id AS step_order, 'detect' AS name, props AS detail FROM events WHERE event_type = 'view')
"""
_FLAG = ", ".join(f"CASE WHEN NOT clean_{c} THEN ('blocking', 'Verification failed ({c}) after remediation: ' || len(left_{c}) || ' left - ' || array_to_string(left_{c}[1:5], ', ')) END" for c in ("text", "metadata", "comments", "hyperlinks"))
_FLAG += ", CASE WHEN NOT clean_images THEN ('blocking', 'Verification failed (images) after remediation: ' || surviving || ' still there, ' || unlocated || ' not located') END, ('info', 'Remediation: ' || redacted || ' images covered, ' || (fixed_metadata + fixed_hyperlinks + fixed_comments) || ' fragments scrubbed')"
_STEP = (
    "CASE WHEN fixed_metadata + fixed_hyperlinks + fixed_comments > 0 THEN ('re-scrub channels', fixed_metadata || ' metadata, "
    "' || fixed_hyperlinks || ' hyperlinks, ' || fixed_comments || ' comments') END, CASE WHEN len(had_text) > 0 THEN ('re-mask text', len(had_text) "
    "|| ' surfaces: ' || array_to_string(had_text[1:5], ', ')) END, ('redact flagged images', CASE WHEN stored > 0 THEN 'stored groups' "
    "ELSE 'fresh scan' END || '; ' || targets || ' targeted, ' || redacted || ' redacted, ' || unlocated || ' not located'), ('verify again', CASE "
    "WHEN clean THEN 'clean' ELSE 'still exposed' END)"
)


def _entries(rows: str, base: str, number: str, a: str, b: str) -> str:
    return (
        f"SELECT n.run_id, (coalesce(m, 0) + generate_subscripts(l, 1))::BIGINT AS {number}, unnest(list_transform(l, lambda x: x[1])) AS {a}, "
        f"unnest(list_transform(l, lambda x: x[2])) AS {b} FROM (SELECT run_id, list_filter([{rows}], lambda x: x IS NOT NULL) AS l FROM r) n LEFT "
        f"JOIN (SELECT run_id, max({number}) AS m FROM {base} GROUP BY run_id) e USING (run_id)"
    )


_GONE = " OR ".join(["(clean_images AND contains(message, 'appear to reveal the client'))", *(f"(clean_{c} AND contains(message, 'Verification failed ({c})'))" for c in remediation.CHANNELS)])
ORACLE = {
    "remediation_refused": (
        "SELECT * FROM (SELECT q.run_id, CASE WHEN page_id IS NULL THEN 'no such run' WHEN q.run_id % 17 = 0 THEN 'not a sanitization run' "
        "WHEN q.run_id % 5 = 0 THEN 'run is completed' WHEN q.run_id % 13 = 0 THEN 'no masked file' END AS reason FROM (SELECT page_id AS run_id FROM pages "
        "WHERE page_id % 2 = 0 UNION SELECT page_id + 1000000 FROM pages WHERE page_id % 50 = 0) q LEFT JOIN pages ON page_id = q.run_id) x "
        "WHERE reason IS NOT NULL"
    ),
    "remediated_items": _SQL + f"SELECT run_id, channel, item, md5(text) AS digest FROM done UNION ALL SELECT run_id, channel, item, md5(text) FROM pg WHERE NOT ({_WORK})",
    "remediated_images": _SQL + f"SELECT run_id, idx, CASE WHEN swapped THEN 'cover' ELSE digest END AS digest, cover OR swapped AS cover, locatable FROM shot UNION ALL SELECT run_id, idx, digest, cover, locatable FROM v WHERE NOT ({_WORK} AND run_id IN (SELECT run_id FROM known))",
    "remediated_groups": _SQL + "SELECT run_id, label AS group_id, list(idx ORDER BY idx) AS indices FROM stored WHERE run_id NOT IN (SELECT run_id FROM r WHERE clean_images) GROUP BY run_id, label",
    "remediated_runs": _SQL + f"SELECT k.run_id, CASE WHEN k.run_id % 17 = 0 THEN 'tagging' ELSE 'sanitization' END AS agent, CASE WHEN k.run_id % 5 = 0 OR r.clean THEN 'completed' ELSE 'completed_with_issues' END AS status, k.run_id % 13 <> 0 AS has_file, ['token', 'black', 'remove'][k.run_id % 3 + 1] AS style, (k.run_id % 4 + coalesce(r.redacted, 0))::BIGINT AS images_redacted, coalesce(r.clean, false) AS verified, {', '.join(f'clean_{c} AS verified_{c}' for c in remediation.CHANNELS)} FROM known k LEFT JOIN r USING (run_id)",
    "remediated_flags": _SQL + f"SELECT run_id, seq, severity, message FROM f LEFT JOIN r USING (run_id) WHERE NOT coalesce(severity = 'blocking' AND ({_GONE}), false) UNION ALL {_entries(_FLAG, 'f', 'seq', 'severity', 'message')}",
    "remediated_steps": _SQL + f"SELECT * FROM s UNION ALL {_entries(_STEP, 's', 'step_order', 'name', 'detail')}",
    "remediated_tagging": _SQL + "SELECT run_id FROM known WHERE run_id % 9 = 0 UNION ALL SELECT run_id FROM r WHERE clean AND run_id % 9 <> 0",
}
_LATER = "run_id % 3 = 0 AND run_id % 17 <> 0 AND run_id % 13 <> 0"
_COUNT = lambda s: f"len(regexp_extract_all({_DOUBLE.format('text')}, '(?i)(?:^|[^A-Za-z0-9]){s}(?:[^A-Za-z0-9]|$)'))"
_THEN = (
    f"WITH b AS MATERIALIZED (SELECT page_id AS run_id, text || CASE WHEN page_id % 7 = 1 THEN ' [CLIENT_5] Turbine Ltd. and' ELSE '' END AS text FROM {_PAGE} p WHERE channel = 'text'), "
    f"n AS MATERIALIZED (SELECT run_id, {_COUNT('is')} AS n_is, {_COUNT('on')} AS n_on, CASE WHEN (run_id + 2) % 4 = 0 THEN {_COUNT('the')} END AS n_the FROM b WHERE {_LATER}) "
)
ORACLE |= {
    "reapplied_occurrences": _THEN + "SELECT * FROM (SELECT run_id, 'is' AS surface, n_is::BIGINT AS n FROM n UNION ALL SELECT run_id, 'on', n_on FROM n UNION ALL SELECT run_id, 'the', n_the FROM n) x WHERE n > 0",
    "reapplied_summary": (
        _THEN + "SELECT run_id, applied, n_is + n_on + coalesce(n_the, 0) AS occurrences, (run_id % 7 = 1)::BIGINT AS remaining, "
        "CASE WHEN run_id % 7 = 1 THEN round_even(100.0::DOUBLE * names / (names + 1), 1)::DOUBLE ELSE 100.0::DOUBLE END AS score "
        "FROM (SELECT *, (2 + (n_the IS NOT NULL)::INT)::BIGINT AS applied, (2 + (n_the IS NOT NULL)::INT + (run_id % 4 <> 0)::INT + ((run_id + 1) % 4 <> 0)::INT + ((run_id + 2) % 4 <> 0)::INT) AS names FROM n)"
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE}
