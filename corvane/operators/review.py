"""Applying review edits: merges, run maps, approvals, labels and attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.patterns import normalized_ascii
from corvane.sources.shared import materialize


def merged_surfaces(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """run_id, surface, entity, missed, merged: a merge (run_id, surface, canonical) gives a surface the canonical one's entity.

    ``entities`` (run_id, ord, surface, entity) are a run's, in order. What no
    merge names is resolved first, then what a merge names, each in order of
    ``ord``; a canonical surface is looked up, in any case, among those resolved
    so far, and the last one of that spelling counts. So a chain follows where
    its later links come first, and in a cycle the first surface misses. A miss
    keeps its own entity. Merges into blanks do not count; of several merges of
    one surface the smallest canonical name does. One row for each surface of a
    run: of repeats the last one's.
    """
    wanted = merges.where(F.trim("canonical") != "").groupBy("run_id", "surface").agg(F.min(F.trim("canonical")).alias("canonical"))
    rows = entities.join(wanted, ["run_id", "surface"], "left").select(
        "run_id", "surface", "entity", F.lower("surface").alias("key"), F.lower("canonical").alias("sought"), F.struct(F.col("canonical").isNotNull().alias("source"), "ord", "surface").alias("at")
    )
    # What is sought among surfaces that no merge names is one row for each key, so a hot name is an even join;
    # only names that are merged themselves depend on the order, link by link.
    plain = rows.where("sought is null").groupBy("run_id", F.col("key").alias("sought")).agg(F.max("at").alias("plain_at"))
    sources = rows.where("sought is not null").join(plain, ["run_id", "sought"], "left")
    chained = sources.join(sources.select("run_id", F.col("key").alias("sought")).distinct(), ["run_id", "sought"], "left_semi")
    seen = chained.select("run_id", F.col("sought").alias("name"), "at", F.lit(False).alias("defines"), F.col("at").alias("asker"))
    named = sources.select("run_id", F.col("key").alias("name"), "at", F.lit(True).alias("defines"), F.lit(None).cast(rows.schema["at"].dataType).alias("asker"))
    before = Window.partitionBy("run_id", "name").orderBy("at", "defines").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("defines"), F.col("at")), ignorenulls=True).over(before)
    links = seen.unionByName(named.join(seen.select("run_id", "name").distinct(), ["run_id", "name"], "left_semi")).withColumn("chain_at", last).where("not defines")
    parents = sources.join(links.select("run_id", F.col("asker").alias("at"), "chain_at").distinct(), ["run_id", "at"], "left")
    parents = parents.select("run_id", "at", F.coalesce("chain_at", "plain_at").alias("parent"))
    roots = _roots(parents.where("parent is not null"))
    own = rows.groupBy("run_id", F.col("at").alias("root")).agg(F.min("entity").alias("merged"))
    found = rows.join(roots, ["run_id", "at"], "left").join(own, ["run_id", "root"], "left")
    resolved = found.select("run_id", "surface", "at", F.coalesce("merged", "entity").alias("entity"), (F.col("sought").isNotNull() & F.col("root").isNull()).alias("missed"), F.col("root").isNotNull().alias("merged"))
    return resolved.groupBy("run_id", "surface").agg(F.max_by(F.struct("entity", "missed", "merged"), "at").alias("x")).select("run_id", "surface", "x.*")


def _roots(parents: DataFrame) -> DataFrame:
    """(run_id, at, root) of rows that point to earlier ones: each round doubles how far a pointer reaches."""
    pointers = materialize(parents.select("run_id", "at", F.col("parent").alias("root")).distinct(), "merge-pointers")
    while True:
        further = pointers.select("run_id", F.col("at").alias("root"), F.col("root").alias("further"))
        moved = pointers.join(further, ["run_id", "root"], "left").select("run_id", "at", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialize(moved, "merge-pointers")
        pointers = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return pointers


def merge_aliases(resolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity, surface) that successful merges add to the aliases: one for each key that no alias has yet, the smallest spelling."""
    key = normalized_ascii(F.col("surface"))
    new = resolved.where("merged").withColumn("key", key).join(aliases.select(key.alias("key")).distinct(), "key", "left_anti")
    return new.groupBy("key").agg(F.min(F.struct("surface", "entity")).alias("x")).select("x.entity", "x.surface")


def run_map(occurrences: DataFrame, entities: DataFrame) -> DataFrame:
    """run_id, surface, token: the first surface of each spelling in a run; occurrences without an entity do not count."""
    first = Window.partitionBy("run_id", F.lower("surface")).orderBy("occurrence_id")
    rows = occurrences.where("entity_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.join(entities.select("entity_id", "token"), "entity_id").select("run_id", "surface", "token")


def approved_images(groups: DataFrame, images: DataFrame) -> DataFrame:
    """Images of approved (indices) groups by index; a group none of whose indices exist falls back to equal content (digest)."""
    wanted = groups.select("group_id", "digest", F.explode("indices").alias("idx"))
    by_index = wanted.join(images.select("idx", F.col("digest").alias("image_digest")), "idx").select("group_id", "idx")
    lost = groups.join(by_index.select("group_id").distinct(), "group_id", "left_anti")
    by_content = lost.select("group_id", "digest").join(images, "digest").select("group_id", "idx")
    return by_index.unionByName(by_content).distinct()


def surviving(before: DataFrame, after: DataFrame) -> DataFrame:
    """Images that were to go and whose bytes are still in the file."""
    return before.join(after.select("digest").distinct(), "digest", "left_semi")


def image_labels(groups: DataFrame, entities: DataFrame, client: str | None) -> DataFrame:
    """group_id, label: the custom name of the entity read in the image, else of the client; null if neither has one."""
    names = entities.groupBy(F.lower("surface").alias("key")).agg(F.min(F.nullif("custom", F.lit(""))).alias("name"))
    own = groups.withColumn("key", F.lower("ocr")).join(names, "key", "left").withColumnRenamed("name", "read_name")
    rest = own.withColumn("client_key", F.lower(F.lit(client).cast("string"))).join(names.withColumnRenamed("key", "client_key"), "client_key", "left")
    return rest.select("group_id", F.coalesce("read_name", "name").alias("label"))


def attributed(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """group_id, entity_id for a stored logo: the entity read in the image, else that of the matched token; no other."""
    by_surface = entities.groupBy(F.lower("surface").alias("key")).agg(F.min("entity_id").alias("read_entity"))
    by_token = entities.groupBy("token").agg(F.min("entity_id").alias("token_entity"))
    rows = groups.withColumn("key", F.lower("ocr")).join(by_surface, "key", "left").join(by_token, "token", "left")
    return rows.select("group_id", F.coalesce("read_entity", "token_entity").alias("entity_id")).where("entity_id is not null")


def approved_residuals(residuals: DataFrame, chosen: DataFrame) -> DataFrame:
    """Residuals (run_id, list) at the chosen places; places out of range do not count."""
    return residuals.select("run_id", F.posexplode("list").alias("place", "residual")).join(chosen.select("run_id", "place").distinct(), ["run_id", "place"], "left_semi")


def resolved_flags(flags: DataFrame, clean: DataFrame) -> DataFrame:
    """Flags left when the blocking ones that name a channel verified clean are gone."""
    named = clean.where("clean").select("run_id", "channel")
    blocking = flags.severity == "blocking"
    gone = flags.where(blocking).join(named, (flags.run_id == named.run_id) & F.lower("message").contains(F.lower("channel"))).select(flags.flag_id).distinct()
    return flags.join(gone, "flag_id", "left_anti")


def applied_tags(tags: DataFrame, removed: DataFrame, vocabulary: DataFrame, decision: Column) -> DataFrame:
    """Tags that a review leaves: known terms that were not removed, confirmed by an approving decision."""
    known = vocabulary.where("status = 'approved'").select("category", "value")
    left = tags.join(removed.select("category", "value"), ["category", "value"], "left_anti").join(known, ["category", "value"], "left_semi")
    return left.withColumn("status", F.when(decision.isin("approved", "edited"), "confirmed").otherwise("applied"))
