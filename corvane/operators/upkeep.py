"""Requests against snapshots: owners, roles, terms, steps and references. Each gives the next rows, and the audit rows if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.patterns import normalized_ascii
from corvane.operators.governance import EVERYTHING, allocated_tokens, inserted

#: The role that may own accounts.
OWNER_ROLE = "practice_lead"


def owner_changes(owners: DataFrame, requests: DataFrame, people: DataFrame) -> DataFrame:
    """(account, user_id, seq, action) of the requests that change something: one audit row each.

    ``requests`` (account, user_id, seq, action: assign or remove) are taken in
    order of ``seq``. Both are idempotent; people without the owner role, or who
    are unknown, cannot be assigned.
    """
    able = people.where(F.col("role") == OWNER_ROLE).select("user_id", F.lit(True).alias("able"))
    asked = requests.join(able, "user_id", "left").where((F.col("action") == "remove") | F.col("able"))
    have = owners.select("account", "user_id").distinct().withColumn("had", F.lit(True))
    before = F.lag(F.col("action") == "assign").over(Window.partitionBy("account", "user_id").orderBy("seq"))
    rows = asked.join(have, ["account", "user_id"], "left").withColumn("owned", F.coalesce(before, F.col("had"), F.lit(False)))
    return rows.where((F.col("action") == "assign") != F.col("owned")).select("account", "user_id", "seq", "action")


def owners_after(owners: DataFrame, changes: DataFrame) -> DataFrame:
    """(account, user_id) after the changes."""
    last = changes.groupBy("account", "user_id").agg(F.max_by("action", "seq").alias("action"))
    kept = owners.select("account", "user_id").distinct().join(last.where("action = 'remove'"), ["account", "user_id"], "left_anti")
    return kept.unionByName(last.where("action = 'assign'").select("account", "user_id")).distinct()


def role_changes(people: DataFrame, requests: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, seq, old, role) of the valid requests in order: an audit row each, also where the role stays; unknown roles and people are refused."""
    valid = requests.join(roles.select("role").distinct(), "role", "left_semi").join(people.select("user_id", F.col("role").alias("first")), "user_id")
    before = F.lag("role").over(Window.partitionBy("user_id").orderBy("seq"))
    return valid.select("user_id", "seq", F.coalesce(before, "first").alias("old"), "role")


def roles_after(people: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, role): the last valid role, or the one before."""
    last = changes.groupBy("user_id").agg(F.max_by("role", "seq").alias("new"))
    return people.join(last, "user_id", "left").select("user_id", F.coalesce("new", "role").alias("role"))


def term_requests(vocabulary: DataFrame, requests: DataFrame) -> DataFrame:
    """(category, value, status) after requests (category, value, manager, seq); values lower-cased.

    A term that is there in any status is refused; the first request for a new
    one counts: a manager's is approved, another's waits for approval.
    """
    asked = requests.withColumn("value", F.lower(F.trim("value"))).where("value <> ''")
    status = F.when(F.col("manager"), "approved").otherwise("pending_approval")
    first = asked.groupBy("category", "value").agg(F.min_by(status, "seq").alias("status"))
    return inserted(vocabulary.select("category", "value", "status"), first, ["category", "value"])


def terms_decided(vocabulary: DataFrame, decisions: DataFrame) -> DataFrame:
    """The vocabulary after decisions (category, value, decision): approve sets the status, delete takes the term out for good."""
    asked = decisions.groupBy("category", "value").agg(F.bool_or(F.col("decision") == "delete").alias("gone"), F.bool_or(F.col("decision") == "approve").alias("approved"))
    rows = vocabulary.join(asked, ["category", "value"], "left").where(~F.coalesce("gone", F.lit(False)))
    return rows.select("category", "value", F.when(F.col("approved"), "approved").otherwise(F.col("status")).alias("status"))


def statuses_decided(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities (entity_id, status, account) after (entity_id, decision, account, seq), taken in order of ``seq``.

    approve may link an account, and keeps the stored one where it names none;
    skip; unskip goes back to waiting. The last decision sets the status.
    """
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "skip", "skipped").when(F.col("decision") == "unskip", "pending_approval")
    linked = F.when(F.col("decision") == "approve", F.col("account"))
    # max_by passes over rows whose order is null, so only what decides something counts.
    last = decisions.groupBy("entity_id").agg(
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("decided"), F.max_by(linked, F.when(linked.isNotNull(), F.col("seq"))).alias("linked")
    )
    return entities.join(last, "entity_id", "left").select("entity_id", F.coalesce("decided", "status").alias("status"), F.coalesce("linked", "account").alias("account"))


def entities_created(dictionary: DataFrame, seen: DataFrame) -> DataFrame:
    """(surface, entity_type, token) of surfaces whose key the dictionary (surface, token) lacks; a known key changes nothing.

    Of spellings with one key the smallest is entered, with its smallest type.
    """
    key = normalized_ascii(F.col("surface"))
    new = seen.withColumn("key", key).join(dictionary.select(key.alias("key")).distinct(), "key", "left_anti")
    first = new.groupBy("key").agg(F.min("surface").alias("surface"), F.min("entity_type").alias("entity_type")).drop("key")
    return allocated_tokens(first, dictionary.select("token")).select("surface", "entity_type", "token")


def references_stored(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Logo references with the new ones (entity_id, phash); blank hashes are refused, repeats are not."""
    return stored.unionByName(new.where(F.trim(F.coalesce("phash", F.lit(""))) != ""))


def ordered_steps(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(run_id, seq, step_order) of new steps (run_id, seq, own_order): their own number if it is set and not 0, else the running one after the existing steps."""
    base = existing.groupBy("run_id").agg(F.count(F.lit(1)).alias("base"))
    running = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) + F.coalesce("base", F.lit(0))
    return new.join(base, "run_id", "left").select("run_id", "seq", F.coalesce(F.nullif("own_order", F.lit(0)), running).cast("long").alias("step_order"))


def run_confidence(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(run_id, confidence): the least of what was found, 1 where nothing was."""
    return runs.select("run_id").join(found.groupBy("run_id").agg(F.min("confidence").alias("least")), "run_id", "left").select("run_id", F.coalesce("least", F.lit(1.0)).alias("confidence"))


def total_occurrences(text: DataFrame, image: DataFrame, alt: DataFrame) -> DataFrame:
    """key, in_text, in_images, in_alt, total from (key, n) of each channel; a key of any channel is there."""
    channels = {"in_text": text, "in_images": image, "in_alt": alt}
    rows = None
    for name, counts in channels.items():
        own = counts.select("key", *[(F.col("n") if c == name else F.lit(0)).cast("long").alias(c) for c in channels])
        rows = own if rows is None else rows.unionByName(own)
    sums = rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in channels])
    return sums.withColumn("total", sum((F.col(c) for c in channels), F.lit(0)).cast("long"))


def image_occurrences(groups: DataFrame) -> DataFrame:
    """(key, n) from (group_id, key, idx): each key of a group counts all of the group's images once."""
    sizes = groups.groupBy("group_id").agg(F.countDistinct("idx").alias("size"))
    keys = groups.where("key is not null").select("group_id", "key").distinct()
    return keys.join(sizes, "group_id").groupBy("key").agg(F.sum("size").alias("n"))


def first_known(strings: DataFrame, dictionary: DataFrame, own: Column, identifier: str) -> DataFrame:
    """(key, entity, surface): of the strings (key, ord, text) of each key, the first that the dictionary (surface, entity) knows or that is an identifier; the firm's own are skipped."""
    rows = strings.where(~F.coalesce(own, F.lit(False)) & (F.trim("text") != "")).withColumn("said", normalized_ascii(F.col("text")))
    known = dictionary.select(normalized_ascii(F.col("surface")).alias("said"), "entity").groupBy("said").agg(F.min("entity").alias("entity"))
    hits = rows.join(known, "said", "left").where(F.col("entity").isNotNull() | F.col("text").rlike(identifier))
    first = hits.groupBy("key").agg(F.min_by(F.struct("entity", "text"), "ord").alias("x"))
    return first.select("key", "x.entity", F.col("x.text").alias("surface"))


def is_placeholder(texts: Column, pixels: Column, gray: int = 60, near: int = 15, share: float = 0.85) -> Column:
    """Whether an image is the engine's own cover: all that is read on it says REDACTED, or nearly all pixels are its gray."""
    only = (F.size(texts) > 0) & F.forall(texts, lambda t: F.upper(F.trim(t)) == "REDACTED")
    close = F.size(F.filter(pixels, lambda p: F.abs(p - gray) <= near)) > share * F.size(pixels)
    return F.coalesce(only, F.lit(False)) | F.coalesce(close, F.lit(False))


def readable_fragments(strings: DataFrame, own: Column, skipped: DataFrame) -> DataFrame:
    """Strings (text) read from images that may name someone: two characters or more, not digits alone, not the firm's own, not skipped terms."""
    rows = strings.where((F.length(F.trim("text")) >= 2) & ~F.trim("text").rlike(r"^\d+$") & ~F.coalesce(own, F.lit(False)))
    gone = skipped.select(normalized_ascii(F.col("surface")).alias("said")).distinct()
    return rows.withColumn("said", normalized_ascii(F.col("text"))).join(gone, "said", "left_anti").drop("said")


def fresh_hits(hits: DataFrame, own: Column) -> DataFrame:
    """Hits (text) of a second look that are not blank, not a bare token and not the firm's own."""
    return hits.where((F.trim("text") != "") & ~F.trim("text").rlike(r"^\[[A-Z_]+_\d+\]$") & ~F.coalesce(own, F.lit(False)))


def precision_misses(proposed: DataFrame, removed: DataFrame) -> DataFrame:
    """(run_id, entity_type, n): proposed (run_id, surface, entity_type) that the reviewer removed, in any case."""
    gone = removed.select("run_id", F.lower("surface").alias("key")).distinct()
    return proposed.withColumn("key", F.lower("surface")).join(gone, ["run_id", "key"], "left_semi").groupBy("run_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def newest_first(rows: DataFrame, owner: str, *order: str) -> DataFrame:
    """The rows with their place in their owner's list, newest first; ties by the last column."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*[F.col(c).desc() for c in order])))


def with_new_entries(old: Column, new: Column) -> Column:
    """Two maps as one; where both have a key the new one's value counts."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def accounts_created(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, name, outcome) of requests (request, seq, name) for new accounts: of one exact name the first is created, unless it is there; all others conflict."""
    have = accounts.select("name").distinct().withColumn("have", F.lit(True))
    place = F.row_number().over(Window.partitionBy("name").orderBy("seq"))
    rows = requests.where(F.trim("name") != "").join(have, "name", "left").withColumn("place", place)
    return rows.select("request", "name", F.when(F.col("have").isNull() & (F.col("place") == 1), "created").otherwise("conflict").alias("outcome"))


def aliases_set(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """Entities (entity_id, custom) with the last validated replacement of (entity_id, seq, custom); a blank one takes it away."""
    last = requests.groupBy("entity_id").agg(F.max_by(F.struct("custom"), "seq").alias("x"))
    rows = entities.join(last, "entity_id", "left")
    return rows.select("entity_id", F.when(F.col("x").isNotNull(), F.nullif(F.trim("x.custom"), F.lit(""))).otherwise(F.col("custom")).alias("custom"))


def reviews_submitted(runs: DataFrame, requests: DataFrame, agents: DataFrame) -> DataFrame:
    """(request, run_id, seq, reviewer, decision, agent, outcome) of requests (request, run_id, seq, reviewer, role, decision) to decide on runs.

    A run (run_id, created_by, agent, status) that waits for review is decided
    by the first request that may: not its creator's, unless an admin, and of a
    known agent (agent). Later ones find it decided; a rejection rejects the
    run, all else completes it.
    """
    known = agents.select("agent").distinct().withColumn("known", F.lit(True))
    asked = requests.join(runs, "run_id", "left").join(known, "agent", "left")
    refused = (
        F.when(F.col("status").isNull(), "no such run").when(F.col("status") != "awaiting_review", F.concat(F.lit("run is "), "status"))
        .when((F.col("created_by") == F.col("reviewer")) & (F.col("role") != EVERYTHING), "own run").when(F.col("known").isNull(), "unknown agent")
    )
    rows = asked.withColumn("refused", refused)
    first = rows.where("refused is null").groupBy("run_id").agg(F.min("seq").alias("decided_at"), F.min_by("decision", "seq").alias("decided"))
    after = F.when(F.col("decided") == "rejected", "rejected").otherwise("completed")
    rows = rows.join(first, "run_id", "left")
    # A run that is decided is no longer waiting, whoever asks; before that each has its own reason.
    outcome = F.when(F.col("seq") > F.col("decided_at"), F.concat(F.lit("run is "), after)).otherwise(F.coalesce("refused", F.lit("accepted")))
    return rows.select("request", "run_id", "seq", "reviewer", "decision", "agent", outcome.alias("outcome"))


def review_items_after(items: DataFrame, submitted: DataFrame) -> DataFrame:
    """(run_id, item, reviewer, decision): accepted decisions stand on the run's latest item (run_id, item, …), or on a first one numbered 1."""
    accepted = submitted.where("outcome = 'accepted'").select("run_id", F.col("reviewer").alias("new_reviewer"), F.col("decision").alias("new_decision"))
    last = items.groupBy("run_id").agg(F.max("item").alias("item")).join(accepted, "run_id")
    changed = items.join(last, ["run_id", "item"], "left")
    kept = changed.select("run_id", "item", F.coalesce("new_reviewer", "reviewer").alias("reviewer"), F.coalesce("new_decision", "decision").alias("decision"))
    first = accepted.join(items.select("run_id").distinct(), "run_id", "left_anti")
    return kept.unionByName(first.select("run_id", F.lit(1).cast("long").alias("item"), F.col("new_reviewer").alias("reviewer"), F.col("new_decision").alias("decision")))


def review_audit(submitted: DataFrame) -> DataFrame:
    """(run_id, actor, action) of the accepted decisions."""
    return submitted.where("outcome = 'accepted'").select("run_id", F.col("reviewer").alias("actor"), F.concat(F.lit("review_"), "decision", F.lit(": "), "agent").alias("action"))
