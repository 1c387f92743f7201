"""Remediation of finished runs that still show names: scrub, mask and cover again, verify, rewrite flags and steps.

Tables, all keyed by run_id:

* ``runs`` (run_id, agent, status, has_file, style, images_redacted, verified_<channel> …, verified)
* ``items`` (run_id, channel, item, text): the masked file, channel by channel
* ``images`` (run_id, idx, digest, cover, locatable): its images; covers are the engine's own
* ``groups`` (run_id, group_id, indices): images that the last verification has left; empty for older runs
* ``flags`` (run_id, seq, severity, message), ``steps`` (run_id, step_order, name, detail)
* ``mask_map`` (run_id, surface, token, ord): what the run masks, and ``fresh_groups``, as ``groups``: what a new
  scan finds in runs that have none stored

Each run meets its own map, so no dictionary is shared; everything is keyed by
run_id, and nothing of a run but its map and lists of finds is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.patterns import LEGAL_SUFFIXES
from corvane.operators.automaton import Automaton, claimed
from corvane.operators.channels import completeness
from corvane.operators.spans import replaced
from corvane.sources.shared import materialize
from corvane.sources.snapshots import Snapshots

AGENT, OPEN, DONE = "sanitization", "completed_with_issues", "completed"
SCRUBBED = ("metadata", "hyperlinks", "comments")
CHANNELS = ("text", "images", "metadata", "comments", "hyperlinks")
# The phrases by which flags name a channel or images; results depend on them.
FAILED, REVEALS = "Verification failed ({})", "appear to reveal the client"
SHOWN = 5
COVER = "cover"


def refused(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, reason) of every request that cannot be met."""
    asked = requests.select("run_id").distinct().join(runs, "run_id", "left")
    reason = (
        F.when(F.col("agent").isNull(), "no such run").when(F.col("agent") != AGENT, "not a sanitization run")
        .when(F.col("status") != OPEN, F.concat(F.lit("run is "), "status")).when(~F.col("has_file"), "no masked file")
    )
    return asked.select("run_id", reason.alias("reason")).where("reason is not null")


def _pattern(surface: Column) -> Column:
    quoted = F.replace(F.replace(surface, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.lit("\\E\\s+\\Q"))
    return F.concat(F.lit("(?iu)(?<![A-Za-z0-9])\\Q"), quoted, F.lit("\\E(?![A-Za-z0-9])"))


def _maps(mask_map: DataFrame) -> DataFrame:
    """(run_id, map): a run's surfaces, longest first, each with its pattern, token and place."""
    rows = mask_map.where("trim(surface) <> ''").select("run_id", F.struct((-F.length("surface")).alias("n"), "ord", "surface", "token", _pattern(F.col("surface")).alias("pattern")).alias("m"))
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_list("m")).alias("map"))


def _replacement(m: Column, style: Column) -> Column:
    bar = F.repeat(F.lit("█"), F.greatest(F.length(m["surface"]), F.lit(3)))
    to = F.when(style == "remove", "").when(style == "black", bar).otherwise(m["token"])
    return F.replace(F.replace(to, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _remasked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longest-first masking of each text by its run's map; a run's automaton serves its rows in turn."""
    own, automaton = None, None
    for batch in batches:
        out = []
        for run, text, rows, style in zip(*(batch.column(c).to_pylist() for c in ("run_id", "text", "map", "style"))):
            if automaton is None or run != own:
                own, automaton = run, Automaton([(m["ord"], m["surface"], m["token"]) for m in rows or []])
            if text is None:
                out.append(None)
                continue
            spans = claimed([(a, b, automaton.aliases[at]) for at, places in automaton.found(text).items() for a, b in places], len(text))
            parts, at = [], 0
            for start, stop, _, token in spans:
                parts += [text[at:start], replaced(text[start:stop], token, style)]
                at = stop
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(out, pa.string())], names=[*[c for c in batch.schema.names if c != "text"], "text"])


def _left(text: Column, maps: Column) -> Column:
    """The surfaces of a map that still stand in a text, longest first."""
    return F.transform(F.filter(maps, lambda m: F.coalesce(F.regexp_like(text, m["pattern"]), F.lit(False))), lambda m: m["surface"])


def scrubbed_items(items: DataFrame, maps: DataFrame, work: DataFrame) -> DataFrame:
    """(run_id, channel, item, before, text, had, left): items of the runs in ``work`` (run_id, style) scrubbed and masked again.

    ``had`` and ``left`` are the surfaces in it before and after. Metadata,
    links and comments are replaced surface by surface; body text is masked
    longest first, and only in runs where a surface stands in it.
    """
    rows = items.join(work.select("run_id", "style"), "run_id").join(maps, "run_id", "left").withColumn("map", F.coalesce("map", F.expr("cast(array() as array<struct<n:int,ord:bigint,surface:string,token:string,pattern:string>>)")))
    rows = rows.withColumn("before", F.col("text")).withColumn("had", _left(F.col("text"), F.col("map")))
    again = F.aggregate("map", F.col("text"), lambda text, m: F.regexp_replace(text, m["pattern"], _replacement(m, F.col("style"))))
    scrubbed = rows.withColumn("text", F.when(F.col("channel").isin(*SCRUBBED), again).otherwise(F.col("text")))
    body = (F.col("channel") == "text") & (F.size("had") > 0)
    order = [c for c in scrubbed.columns if c != "text"] + ["text"]
    masked = scrubbed.where(body).select(*order).sortWithinPartitions("run_id").mapInArrow(_remasked, scrubbed.select(*order).schema)
    out = scrubbed.where(~body).select(*order).unionByName(masked)
    return out.withColumn("left", _left(F.col("text"), F.col("map"))).select("run_id", "channel", "item", "before", "text", "had", "left")


def covered_images(images: DataFrame, groups: DataFrame, fresh_groups: DataFrame, work: DataFrame) -> DataFrame:
    """(run_id, idx, digest, cover, locatable, targeted, surviving): images of the runs in ``work``, the flagged ones covered.

    Stored groups count where a run has any, else the fresh ones. Covers are no
    targets; an image that cannot be located stays. ``surviving``: its bytes
    are those of a target, and still there.
    """
    stored = groups.join(work.select("run_id"), "run_id", "left_semi")
    fresh = fresh_groups.join(work.select("run_id"), "run_id", "left_semi").join(stored.select("run_id").distinct(), "run_id", "left_anti")
    wanted = stored.unionByName(fresh).select("run_id", F.explode("indices").alias("idx")).distinct().withColumn("wanted", F.lit(True))
    rows = images.join(work.select("run_id"), "run_id", "left_semi").join(wanted, ["run_id", "idx"], "left")
    rows = rows.withColumn("targeted", F.coalesce("wanted", F.lit(False)) & ~F.col("cover"))
    gone = rows.where("targeted").select("run_id", "digest").distinct().withColumn("hunted", F.lit(True))
    swapped = F.col("targeted") & F.col("locatable")
    after = rows.join(gone, ["run_id", "digest"], "left").withColumn("surviving", F.coalesce("hunted", F.lit(False)) & ~swapped)
    return after.select("run_id", "idx", F.when(swapped, COVER).otherwise(F.col("digest")).alias("digest"), (F.col("cover") | swapped).alias("cover"), "locatable", "targeted", "surviving")


def _outcome(work: DataFrame, items: DataFrame, images: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each run: what each channel still shows, what was changed, and the verdicts."""
    said = lambda column: items.select("run_id", "channel", F.explode(column).alias("surface")).distinct()
    lists = lambda rows, prefix, names: rows.groupBy("run_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.col("surface")))).alias(f"{prefix}_{c}") for c in names])
    fixed = items.groupBy("run_id").agg(*[F.count_if((F.col("channel") == c) & ~F.col("text").eqNullSafe(F.col("before"))).alias(f"fixed_{c}") for c in SCRUBBED])
    finds = fixed.join(lists(said("left"), "left", [c for c in CHANNELS if c != "images"]), "run_id", "left").join(lists(said("had"), "had", ["text"]), "run_id", "left")
    pictures = images.groupBy("run_id").agg(
        F.count_if("targeted").alias("targets"), F.count_if(F.col("targeted") & F.col("locatable")).alias("redacted"), F.count_if("surviving").alias("surviving"), F.count_if(F.col("targeted") & ~F.col("locatable")).alias("unlocated")
    )
    stored = groups.groupBy("run_id").agg(F.count(F.lit(1)).alias("stored"))
    rows = work.join(finds, "run_id", "left").join(pictures, "run_id", "left").join(stored, "run_id", "left")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in finds.columns if c.startswith(("left_", "had_"))} | {c: F.coalesce(c, F.lit(0)) for c in [*pictures.columns[1:], "stored", *(f"fixed_{c}" for c in SCRUBBED)]})
    clean = {f"clean_{c}": F.size(f"left_{c}") == 0 for c in CHANNELS if c != "images"} | {"clean_images": (F.col("surviving") == 0) & (F.col("unlocated") == 0)}
    return rows.withColumns(clean).withColumn("clean", F.forall(F.array(*clean), lambda x: x))


def _listed(numbered: Column, base: DataFrame, rows: DataFrame, number: str, *columns: str) -> DataFrame:
    """The entries of each run's list with running numbers after those of ``base``."""
    ends = base.groupBy("run_id").agg(F.coalesce(F.max(number), F.lit(0)).alias("_end"))
    entries = rows.select("run_id", F.posexplode(F.filter(numbered, lambda x: x.isNotNull())).alias("_place", "x"))
    return entries.join(ends, "run_id", "left").select("run_id", (F.coalesce("_end", F.lit(0)) + F.col("_place") + 1).cast("long").alias(number), *[F.col(f"x.{c}").alias(c) for c in columns])


def _new_steps(outcome: DataFrame, steps: DataFrame) -> DataFrame:
    step = lambda name, detail: F.struct(F.lit(name).alias("name"), detail.alias("detail"))
    fixed = sum((F.col(f"fixed_{c}") for c in SCRUBBED), F.lit(0))
    found = F.array(
        F.when(fixed > 0, step("re-scrub channels", F.format_string("%d metadata, %d hyperlinks, %d comments", *(f"fixed_{c}" for c in SCRUBBED)))),
        F.when(F.size("had_text") > 0, step("re-mask text", F.format_string("%d surfaces: %s", F.size("had_text"), F.array_join(F.slice("had_text", 1, SHOWN), ", ")))),
        step("redact flagged images", F.format_string("%s; %d targeted, %d redacted, %d not located", F.when(F.col("stored") > 0, "stored groups").otherwise("fresh scan"), "targets", "redacted", "unlocated")),
        step("verify again", F.when(F.col("clean"), "clean").otherwise("still exposed")),
    )
    return _listed(found, steps, outcome, "step_order", "name", "detail")


def _new_flags(outcome: DataFrame, flags: DataFrame) -> DataFrame:
    flag = lambda severity, message: F.struct(F.lit(severity).alias("severity"), message.alias("message"))
    failed = lambda c, detail: flag("blocking", F.concat(F.lit(FAILED.format(c) + " after remediation: "), detail))
    texts = [
        F.when(~F.col(f"clean_{c}"), failed(c, F.format_string("%d left - %s", F.size(f"left_{c}"), F.array_join(F.slice(f"left_{c}", 1, SHOWN), ", "))))
        for c in ("text", "metadata", "comments", "hyperlinks")
    ]
    pictures = F.when(~F.col("clean_images"), failed("images", F.format_string("%d still there, %d not located", "surviving", "unlocated")))
    told = flag("info", F.format_string("Remediation: %d images covered, %d fragments scrubbed", F.col("redacted"), sum((F.col(f"fixed_{c}") for c in SCRUBBED), F.lit(0))))
    return _listed(F.array(*texts, pictures, told), flags, outcome, "seq", "severity", "message")


def kept_flags(flags: DataFrame, outcome: DataFrame) -> DataFrame:
    """Flags without the blocking ones of a channel, or of images, that are clean now."""
    marks = flags.join(outcome.select("run_id", *[f"clean_{c}" for c in CHANNELS]), "run_id", "left")
    gone = F.col("clean_images") & F.contains("message", F.lit(REVEALS))
    for c in CHANNELS:
        gone = gone | (F.col(f"clean_{c}") & F.contains("message", F.lit(FAILED.format(c))))
    return marks.where(~F.coalesce((F.col("severity") == "blocking") & gone, F.lit(False))).select(*flags.columns)


def remediate(tables: dict[str, DataFrame], requests: DataFrame, chained: bool = True) -> dict[str, DataFrame]:
    """The tables after remediation of the requested runs (run_id); requests that cannot be met change nothing (see ``refused``).

    With ``chained``, ``tagging`` (run_id) gets the runs that are complete now and are not in it.
    """
    runs, items, images, groups, flags, steps = (tables[t] for t in ("runs", "items", "images", "groups", "flags", "steps"))
    able = requests.select("run_id").distinct().join(refused(requests, runs).select("run_id"), "run_id", "left_anti")
    work = runs.join(able, "run_id", "left_semi").select("run_id", "style")
    new_items = materialize(scrubbed_items(items, _maps(tables["mask_map"]), work), "scrubbed")
    new_images = materialize(covered_images(images, groups, tables["fresh_groups"], work), "covered")
    outcome = materialize(_outcome(work, new_items, new_images, groups), "outcome")

    done = outcome.select("run_id", "clean", "redacted", *[f"clean_{c}" for c in CHANNELS])
    joined = runs.join(done, "run_id", "left")
    told = F.col("clean").isNotNull()
    changed = {
        "status": F.when(F.col("clean"), DONE).otherwise(F.col("status")), "images_redacted": F.col("images_redacted") + F.coalesce("redacted", F.lit(0)),
        "verified": F.when(told, F.col("clean")).otherwise(F.col("verified")), **{f"verified_{c}": F.when(told, F.col(f"clean_{c}")).otherwise(F.col(f"verified_{c}")) for c in CHANNELS},
    }
    others = lambda df: df.join(work.select("run_id"), "run_id", "left_anti")
    out = {
        "runs": joined.withColumns(changed).select(*runs.columns),
        "items": others(items).unionByName(new_items.select(*items.columns)),
        "images": others(images).unionByName(new_images.select(*images.columns)),
        "groups": groups.join(outcome.where("clean_images").select("run_id"), "run_id", "left_anti"),
        "flags": kept_flags(flags, outcome).unionByName(_new_flags(outcome, flags)),
        "steps": steps.unionByName(_new_steps(outcome, steps)),
    }
    if chained:
        new = outcome.where("clean").select("run_id").join(tables["tagging"].select("run_id"), "run_id", "left_anti")
        out["tagging"] = tables["tagging"].select("run_id").unionByName(new)
    return out


def remediate_snapshot(store: Snapshots, requests: DataFrame) -> int:
    """Remediate the current version and commit all tables at once; returns the new version's number.

    Done again after a failure it starts from the same version; done again
    after success it refuses the runs that are complete and repeats the others.
    """
    base = store.version()
    return store.commit(remediate(store.tables(base), requests), base)


_LEAK = "\\E\\s*((?:[A-Z][A-Za-z&]*\\s+){0,3}(?:" + "|".join(LEGAL_SUFFIXES) + ")\\.?)(?!\\w)"
# Fixed value: how a flag of an earlier look begins.
FOUND = "Revalidation found"


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that a run's new names claim in a text."""
    own, automaton = None, None
    for batch in batches:
        at, spans = [], []
        for i, (run, text, rows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("run_id", "before", "map")))):
            if automaton is None or run != own:
                own, automaton = run, Automaton([(m["ord"], m["surface"], m["token"]) for m in rows])
            found = claimed([(a, b, automaton.aliases[k]) for k, places in automaton.found(text or "").items() for a, b in places], len(text or ""))
            at += [i] * len(found)
            spans += [(a, b, text[a:b]) for a, b, _, _ in found]
        rows = batch.select(["run_id", "item"]).take(pa.array(at, pa.int64()))
        columns = list(zip(*spans)) if spans else [(), (), ()]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["run_id", "item", "start", "stop", "surface"])


def reapply(tables: dict[str, DataFrame], approved: DataFrame) -> dict[str, DataFrame]:
    """The tables after reviewers approved residual names (run_id, ord, surface, token) of finished sanitization runs with a file.

    Blank names and those that a run masks already do not count; of one name
    the first does. The masked file is scrubbed and masked again by all names;
    ``occurrences`` (run_id, item, start, stop, surface) are the places of the
    new ones in its text before. Then what follows a token like the rest of a
    name is looked for; ``revalidations`` (run_id, applied, occurrences,
    remaining, score) tells what was found. Flags of earlier looks and of the
    four channels go, new ones follow; images keep their verdict.
    """
    runs, items, flags, mask_map = (tables[t] for t in ("runs", "items", "flags", "mask_map"))
    able = runs.where((F.col("agent") == AGENT) & F.col("has_file")).select("run_id")
    asked = approved.select("run_id", "ord", F.trim("surface").alias("surface"), "token").where("surface <> ''").join(able, "run_id", "left_semi")
    new = asked.join(mask_map.select("run_id", "surface"), ["run_id", "surface"], "left_anti").groupBy("run_id", "surface").agg(F.min_by("token", "ord").alias("token"), F.min("ord").alias("ord"))
    new = materialize(new.select("run_id", "surface", "token", (F.col("ord") + F.lit(1 << 32)).alias("ord")), "new-names")
    work = runs.join(new.select("run_id").distinct(), "run_id", "left_semi").select("run_id", "style")
    combined = mask_map.select("run_id", "surface", "token", "ord").unionByName(new)
    done = materialize(scrubbed_items(items, _maps(combined), work), "reapplied")
    body = done.where("channel = 'text'")
    fresh = body.select("run_id", "item", "before").join(_maps(new), "run_id").sortWithinPartitions("run_id").mapInArrow(_fresh, "run_id long, item long, start int, stop int, surface string")
    fresh = materialize(fresh, "new-occurrences")

    tokens = combined.join(work.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.collect_set("token").alias("tokens"), F.count(F.lit(1)).alias("names"))
    leaks = F.flatten(F.transform("tokens", lambda t: F.transform(F.regexp_extract_all("text", F.concat(F.lit("\\Q"), t, F.lit(_LEAK)), F.lit(1)), lambda x: F.struct(t.alias("token"), F.lower(F.trim(x)).alias("leak")))))
    found = body.join(tokens, "run_id").select("run_id", F.explode(leaks).alias("x")).select("run_id", "x.*").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("remaining"))
    left = done.select("run_id", "channel", F.explode("left").alias("surface")).distinct().groupBy("run_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.col("surface")))).alias(f"left_{c}") for c in CHANNELS if c != "images"])
    told = work.join(tokens.select("run_id", "names"), "run_id").join(new.groupBy("run_id").agg(F.count(F.lit(1)).alias("applied")), "run_id").join(fresh.groupBy("run_id").agg(F.count(F.lit(1)).alias("occurrences")), "run_id", "left")
    told = told.join(found, "run_id", "left").join(left, "run_id", "left").na.fill(0, ["occurrences", "remaining"])
    told = materialize(told.withColumn("score", completeness(F.col("names"), F.col("remaining"))), "revalidations")

    clean = {c: F.coalesce(F.size(f"left_{c}") == 0, F.lit(True)) for c in CHANNELS if c != "images"}
    joined = runs.join(told.drop("style"), "run_id", "left")
    changed = F.col("applied").isNotNull()
    now = {f"verified_{c}": F.when(changed, x).otherwise(F.col(f"verified_{c}")) for c, x in clean.items()}
    every = F.coalesce(F.col("verified_images"), F.lit(False))
    for x in clean.values():
        every = every & x
    now |= {"verified": F.when(changed, every).otherwise(F.col("verified")), "status": F.when(changed, F.when(every & (F.col("remaining") == 0), DONE).otherwise(OPEN)).otherwise(F.col("status"))}
    named = F.startswith("message", F.lit(FOUND))
    for c in clean:
        named = named | F.contains("message", F.lit(FAILED.format(c)))
    kept = flags.join(told.select("run_id", "applied"), "run_id", "left").where(~F.coalesce(F.col("applied").isNotNull() & (F.col("severity") == "blocking") & named, F.lit(False))).select(*flags.columns)
    flag = lambda message: F.struct(F.lit("blocking").alias("severity"), message.alias("message"))
    fresh_flags = [
        F.when(F.size(f"left_{c}") > 0, flag(F.concat(F.lit(FAILED.format(c) + " after a fix: "), F.format_string("%d left - %s", F.size(f"left_{c}"), F.array_join(F.slice(f"left_{c}", 1, SHOWN), ", ")))))
        for c in ("text", "metadata", "comments", "hyperlinks")
    ]
    more = F.when(F.col("remaining") > 0, flag(F.format_string(FOUND + " %d more", "remaining")))
    others = items.join(work.select("run_id"), "run_id", "left_anti")
    return {
        "mask_map": combined, "items": others.unionByName(done.select(*items.columns)), "occurrences": fresh, "revalidations": told.select("run_id", "applied", "occurrences", "remaining", "score"),
        "runs": joined.withColumns(now).select(*runs.columns), "flags": kept.unionByName(_listed(F.array(*fresh_flags, more), flags, told, "seq", "severity", "message")),
    }
