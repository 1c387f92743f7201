"""Dictionary upkeep, review edits, vocabulary gate, access rules and their read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.patterns import alike, normalized, with_key
from corvane.operators.ranking import ranked, running

# The token prefix of each entity type; unknown types use the first.
PREFIXES = {"CLIENT_NAME": "CLIENT", "CLIENT_PERSON": "CLIENT_PERSON", "CLIENT_LOCATION": "CLIENT_LOCATION", "CLIENT_EMAIL_DOMAIN": "CLIENT_DOMAIN", "CLIENT_SYSTEM_NAME": "CLIENT_SYSTEM", "CLIENT_CONTRACT_ID": "CLIENT_CONTRACT"}
TAG_FROM, STALE_DAYS = 0.7, 14
EVERYTHING = "admin"


def prefix_of(entity_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    return F.coalesce(known[entity_type], F.lit("CLIENT"))


def allocated_tokens(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds token to (entity_type, surface) rows, as one insert after another in surface order gives them.

    An insert of a prefix starts from one more than the tokens so far that the
    pattern [prefix_%] counts, and goes on to the first number that no token
    has. In that pattern the underscore matches any character, so longer
    prefixes that begin alike count as well, new ones too.

    In closed form, for the rows of a prefix in order: ``start`` is where an
    insert begins; among the numbers that are free in ``existing``, it is at
    place ``open``, and the j-th row takes the place j + max(open - j) over the
    rows up to it. All three steps are running folds over range partitions.
    """
    kinds = sorted(set(PREFIXES.values()))
    # One pass over the tokens counts all prefixes; the result has a row for each of these few.
    counts = existing.agg(*[F.count_if(F.col("token").like(f"[{kind}_%]")).alias(kind) for kind in kinds])
    by_kind = lambda made: F.coalesce(*[F.when(F.col("prefix") == kind, made(i, kind)) for i, kind in enumerate(kinds)])
    wanted = ranked(new.withColumn("prefix", prefix_of(F.col("entity_type"))), "surface", "entity_type")
    one = lambda test: test.cast("long")
    counted = {f"_n{i}": one(F.col("prefix").startswith(kind)) for i, kind in enumerate(kinds)} | {f"_j{i}": one(F.col("prefix") == kind) for i, kind in enumerate(kinds)}
    placed = running(wanted, F.sum, **counted).join(F.broadcast(counts)).select(
        *new.columns, "prefix", by_kind(lambda i, kind: F.col(f"_n{i}") + F.col(kind)).alias("number"), by_kind(lambda i, kind: F.col(f"_j{i}")).alias("j"), F.lit(0).alias("taken")
    )
    token = r"^\[(.+)_([1-9][0-9]{0,17})\]$"
    numbers = existing.select(F.regexp_extract("token", token, 1).alias("prefix"), F.try_to_number(F.regexp_extract("token", token, 2), F.lit("9" * 18)).cast("long").alias("number")).where(F.col("prefix").isin(kinds)).distinct()
    below = F.struct(*[F.sum(one(F.col("prefix") < kind)).alias(f"_t{i}") for i, kind in enumerate(kinds)])
    base = numbers.agg(below.alias("base"))
    taken = lambda rows: running(rows, F.sum, t=F.col("taken").cast("long")).join(F.broadcast(base)).withColumn("t", F.col("t") - by_kind(lambda i, kind: F.coalesce(F.col("base")[f"_t{i}"], F.lit(0)))).drop("base")

    starts = taken(ranked(placed.unionByName(numbers.withColumn("taken", F.lit(1)), allowMissingColumns=True), "prefix", "number", "taken"))
    ahead = F.when(F.col("taken") == 0, F.struct("prefix", (F.col("number") - F.col("t") - F.col("j")).alias("d")))
    opened = running(starts, F.max, most=ahead).withColumn("number", F.when(F.col("taken") == 0, F.col("j") + F.col("most.d")).otherwise(F.col("number") - F.col("t"))).drop("t", "most", "_at")
    given = taken(ranked(opened, "prefix", "number", "taken")).where("taken = 0")
    return given.select(*new.columns, F.format_string("[%s_%d]", "prefix", F.col("number") + F.col("t")).alias("token"))


def alias_collisions(proposed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(entity_id, replacement, other_id, reason): replacements that name, or repeat that of, another entity.

    Surfaces meet replacements on the surface's longest ASCII token, an
    equi-join, and the pattern confirms; surfaces without one meet them on the
    first two characters, blanks and case made alike.
    """
    others = dictionary.select(F.col("entity_id").alias("other_id"), F.trim("surface").alias("surface"), F.nullif("custom", F.lit("")).alias("custom"))
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")
    longest = F.element_at(F.array_sort(F.transform(tokens("surface"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"]
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(alike(F.col("replacement"))), F.lit(1))), lambda i: F.substring(alike(F.col("replacement")), i, F.lit(2)))
    # Tokens are in lower case and pairs start with a mark, so the two kinds of key never meet.
    start = F.concat(F.lit("="), F.substring(alike(F.col("surface")), 1, 2))
    keyed = others.where(F.length("surface") >= 3).select("other_id", "surface", F.when(F.size(tokens("surface")) > 0, longest).otherwise(start).alias("token"))
    quoted = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])\Q"), F.replace("surface", F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    said = proposed.withColumn("token", F.explode(F.array_distinct(F.concat(tokens("replacement"), F.transform(pairs, lambda x: F.concat(F.lit("="), x))))))
    names = said.join(keyed, "token").where(F.regexp_like("replacement", quoted)).withColumn("reason", F.lit("names"))
    own = proposed.withColumn("key", normalized("replacement"))
    repeats = own.join(others.where("custom is not null").select("other_id", normalized("custom").alias("key")), "key").withColumn("reason", F.lit("repeats"))
    columns = ("entity_id", "replacement", "other_id", "reason")
    return names.select(*columns).unionByName(repeats.select(*columns)).where("entity_id <> other_id").distinct()


def upserted(snapshot: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The next snapshot: of old and changed rows, the newest of each key."""
    both = snapshot.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def inserted(snapshot: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot and the new rows whose key it lacks: insert if absent."""
    return snapshot.unionByName(new.join(snapshot.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def review_removals(proposed: DataFrame, removed: DataFrame) -> DataFrame:
    """What stays of (run_id, surface) after the reviewer's removals, by lower-cased surface; each once.

    Both sides meet in one shuffle by run and key.
    """
    gone = removed.where("run_id is not null and surface is not null").select("run_id", F.lower("surface").alias("key"), F.lit(None).cast("string").alias("surface"), F.lit(True).alias("gone"))
    both = proposed.select("run_id", F.lower("surface").alias("key"), "surface", F.lit(False).alias("gone")).unionByName(gone).repartition("run_id", "key")
    spelled = both.groupBy("run_id", "key", "surface").agg(F.max("gone").alias("gone"))
    stays = spelled.withColumn("gone", F.max("gone").over(Window.partitionBy("run_id", "key"))).where("not gone")
    return stays.select("run_id", "surface")


def review_additions(proposed: DataFrame, added: DataFrame) -> DataFrame:
    """Reviewer's additions that were not proposed, each dictionary key once, the first by ``ord``; both sides meet in one shuffle by run and key."""
    first = F.struct("ord", "surface")
    have = with_key(proposed.where("run_id is not null").select("run_id", "surface")).select("run_id", "key").withColumn("x", F.lit(None).cast(added.select(first.alias("x")).schema["x"].dataType))
    new = with_key(added.where(F.trim("surface") != "").select("run_id", "ord", "surface")).select("run_id", "key", first.alias("x"))
    both = new.unionByName(have).where("key is not null").repartition("run_id", "key")
    # What was proposed has no struct, and so comes first.
    place = Window.partitionBy("run_id", "key").orderBy(F.col("x").asc_nulls_first())
    return both.withColumn("_n", F.row_number().over(place)).where("_n = 1 and x is not null").select("run_id", "x.ord", "x.surface")


def review_deltas(missed: DataFrame, wrong: DataFrame) -> DataFrame:
    """entity_type, recall_misses, precision_misses over all runs; each type that either has."""
    a = missed.groupBy("entity_type").agg(F.count(F.lit(1)).alias("recall_misses"))
    b = wrong.groupBy("entity_type").agg(F.count(F.lit(1)).alias("precision_misses"))
    return a.join(b, "entity_type", "full_outer").na.fill(0, ["recall_misses", "precision_misses"])


def review_delta_totals(runs: DataFrame, missed: DataFrame, wrong: DataFrame) -> DataFrame:
    """One row: total_runs_checked, and runs_with_data, those of ``runs`` (run_id) that have a miss (run_id) of either kind."""
    some = missed.select("run_id").unionByName(wrong.select("run_id")).distinct().withColumn("some", F.lit(True))
    checked = runs.select("run_id").distinct().join(some, "run_id", "left")
    return checked.agg(F.count(F.lit(1)).alias("total_runs_checked"), F.count("some").alias("runs_with_data"))


def tag_gate(tags: DataFrame, vocabulary: DataFrame, limit: float = TAG_FROM) -> DataFrame:
    """Adds status: applied, flagged (known but unsure) or proposed_new (not in the approved vocabulary)."""
    known = vocabulary.where("status = 'approved'").select("category", "value", F.lit(True).alias("known"))
    cleaned = tags.withColumn("value", F.lower(F.trim("value"))).where("category <> '' and value <> ''")
    status = F.when(F.col("known").isNull(), "proposed_new").when(F.col("confidence") >= limit, "applied").otherwise("flagged")
    return cleaned.join(known, ["category", "value"], "left").withColumn("status", status).drop("known")


def allowed(people: DataFrame, capabilities: DataFrame, capability: str) -> DataFrame:
    """People (role) who hold the capability; the admin role holds all."""
    holders = capabilities.where(F.col("capability") == capability).select("role").distinct()
    return people.where(F.col("role") == EVERYTHING).unionByName(people.where(F.col("role") != EVERYTHING).join(holders, "role", "left_semi").select(*people.columns))
