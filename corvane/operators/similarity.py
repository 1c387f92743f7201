"""Exact and perceptual duplicates: content hashes, banded Hamming matches, greedy clusters, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.components import connected_components
from corvane.operators.ranking import ranked, running
from corvane.sources.shared import materialize

CONFIDENT, UNCERTAIN, MERGE, CLUSTER_CAP = 4, 10, 10, 150


def exact_groups(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """digest, first key, n of each distinct content; only 32 bytes per row are shuffled."""
    return rows.groupBy(F.sha2(content, 256).alias("digest")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))


HASH = "^[0-9a-fA-F]{16}$"


#: Rows of one value of a part from which on its bucket is cut further, and how often that is done.
HOT_BUCKET, DEPTH = 4096, 3
#: Values that one part of a hash may probe.
MAX_FLIPS = 4096


def _flips(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with up to ``radius`` bits set; none for a radius under 0."""
    return [sum(1 << x for x in flips) for n in range(radius + 1) for flips in combinations(range(width), n)]


def _cuts(width: int, m: int) -> list[tuple[int, int]]:
    ends = [width * k // m for k in range(m + 1)]
    return list(zip(ends, (b - a for a, b in zip(ends, ends[1:]))))


def planned_radii(widths: list[int], limit: int, rows: int, met: list[float]) -> tuple[list[int], float]:
    """A radius for each part (-1: not used) that lose no pair within ``limit`` bits, and what they cost for each probe.

    If every part differed in more bits than its radius, more than ``limit``
    would differ in all: radii and parts that are used sum to limit + 1. The
    next bit of radius goes where it costs least: values to probe, each with the
    rows of an even part, and once the share ``met`` of rows that a row's own
    bucket has.
    """
    cost = lambda i, r: sum(math.comb(widths[i], n) for n in range(r + 1)) * (1 + rows * 2.0 ** -widths[i]) + (r >= 0) * rows * met[i]
    radii = [-1] * len(widths)
    for _ in range(limit + 1):
        i = min((i for i in range(len(widths)) if radii[i] < widths[i]), key=lambda i: cost(i, radii[i] + 1) - cost(i, radii[i]))
        radii[i] += 1
    return radii, sum(cost(i, r) for i, r in enumerate(radii))


def _parts(width: int, limit: int, rows: int) -> int:
    """The number of parts that costs least if all values of a part were equally often, and that probes few enough values of each."""

    def cost(m: int) -> tuple[bool, float]:
        widths = [w for _, w in _cuts(width, m)]
        radii, total = planned_radii(widths, limit, rows, [2.0**-w for w in widths])
        return any(sum(math.comb(w, n) for n in range(r + 1)) > MAX_FLIPS for w, r in zip(widths, radii)), total

    return min(range(1, min(limit + 1, width) + 1), key=cost)


def _met(probes: DataFrame, index: DataFrame, width: int, limit: int, depth: int) -> DataFrame:
    """(phash, ref_phash) pairs of (bucket, phash, x, own) and (bucket, ref_phash, y, other) that may be within ``limit`` bits, x and y having ``width``."""
    rows = index.count()
    cuts = _cuts(width, _parts(width, limit, max(rows, 1)))
    part = lambda number, a, w: F.shiftrightunsigned(number, a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1))
    values = lambda number: F.array(*[part(F.col(number), a, w) for a, w in cuts])
    keyed = index.select("bucket", "ref_phash", "y", "other", F.posexplode(values("y")).alias("place", "value"))
    sizes = keyed.groupBy("bucket", "place", "value").agg(F.count(F.lit(1)).alias("n"))
    mass = {r["place"]: r["s"] for r in sizes.groupBy("place").agg(F.sum(F.col("n").cast("double") * F.least("n", F.lit(HOT_BUCKET))).alias("s")).collect()}
    radii, _ = planned_radii([w for _, w in cuts], limit, rows, [mass.get(i, 0.0) / max(rows, 1) ** 2 for i in range(len(cuts))])
    flips = F.array(*[F.array(*[F.lit(f).cast("long") for f in _flips(w, r)]) if r >= 0 else F.expr("cast(array() as array<bigint>)") for (_, w), r in zip(cuts, radii)])
    asked = probes.select("bucket", "phash", "x", "own", F.posexplode(values("x")).alias("place", "value"))
    asked = asked.select("bucket", "phash", "x", "own", "place", F.explode(F.transform(F.get(flips, F.col("place")), lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
    key, hot = ["bucket", "place", "value"], sizes.where(F.col("n") > HOT_BUCKET).select("bucket", "place", "value")
    if depth == 0 or width - max(w for _, w in cuts) <= limit or hot.isEmpty():
        return _near_pairs(asked, keyed, key, limit)
    hot = materialize(hot, "hot-parts")
    out = _near_pairs(asked.join(hot, key, "left_anti"), keyed.join(hot, key, "left_anti"), key, limit)
    inner = F.xxhash64("bucket", "place", "value").alias("bucket")
    for i, (a, w) in enumerate(cuts):  # inside a hot bucket the part says nothing more: the other bits are cut again
        if radii[i] < 0:
            continue
        rest = lambda c: F.shiftleft(F.shiftrightunsigned(c, a + w), a).bitwiseOR(F.col(c).bitwiseAND(F.lit((1 << a) - 1))) if a + w < 64 else F.col(c).bitwiseAND(F.lit((1 << a) - 1))  # noqa: E731, B023
        one = asked.where(F.col("place") == i).join(hot, key, "left_semi").select(inner, "phash", rest("x").alias("x"), "own")
        two = keyed.where(F.col("place") == i).join(hot, key, "left_semi").select(inner, "ref_phash", rest("y").alias("y"), "other")
        out = out.unionByName(_met(one, two, width - w, limit, depth - 1))
    return out


def _near_pairs(asked: DataFrame, keyed: DataFrame, key: list[str], limit: int) -> DataFrame:
    return asked.join(keyed, key).where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= limit).select("phash", "ref_phash")


#: Hashes in one block, and pairs of blocks that a task compares one after another.
BLOCK, BLOCK_PAIRS = 4096, 64
#: Pairs that are compared in the time of one row that is probed, shuffled and joined.
PAIRS_PER_ROW = 500


def _blocks(rows: DataFrame, number: str, n: int, name: str) -> DataFrame:
    """The numbers dealt to n blocks of about equal size, each one row."""
    dealt = rows.select(F.pmod(F.xxhash64(number, F.lit(1)), F.lit(n)).cast("int").alias(f"{name}_block"), F.col(number))
    return dealt.groupBy(f"{name}_block").agg(F.collect_list(number).alias(name))


def _compared(left: DataFrame, right: DataFrame, limit: int, n_left: int, n_right: int) -> DataFrame:
    """(phash, ref_phash) of all pairs within ``limit`` bits, by comparing blocks with blocks; a task holds two blocks at a time."""
    a, b = (max(1, -(-n // BLOCK)) for n in (n_left, n_right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in ("xs", "ys"))
                for at in range(0, len(x), 256):
                    differ = np.bitwise_count((x[at : at + 256, None] ^ y[None, :]).view(np.uint64))  # of signed numbers it counts the bits of the amount
                    p, q = np.nonzero(differ <= limit)
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at + p]), pa.array(y[q])], names=["x", "y"])

    pairs = _blocks(left, "x", a, "xs").crossJoin(_blocks(right, "y", b, "ys")).select("xs", "ys", "xs_block", "ys_block")
    dealt = pairs.repartition(max(left.sparkSession.sparkContext.defaultParallelism, -(-a * b // BLOCK_PAIRS)), "xs_block", "ys_block").select("xs", "ys")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return dealt.mapInArrow(run, "x long, y long").select(digits("x").alias("phash"), digits("y").alias("ref_phash"))


def near_hashes(left: DataFrame, right: DataFrame, limit: int, banded: bool = False) -> DataFrame:
    """(phash, ref_phash, distance) of all different hashes of both sides within ``limit`` bits, up to 31; each pair once.

    Hashes are cut into parts, as many as cost least for their number; the
    right ones are indexed by the values of their parts, the left ones probe
    with all values within a part's radius, which is smaller where the values
    are uneven. Buckets that hold many hashes are cut again by their other bits.
    Where that would cost more than to compare all pairs, block by block, they
    are compared, unless ``banded``: many bits may differ, and parts then tell
    little. Equal hashes collapse first. What is not 16 hexadecimal digits is
    left out.
    """
    if not 0 <= limit < 32:
        raise ValueError("limit must be from 0 to 31")

    def told(rows: DataFrame, name: str, number: str, whole: str) -> DataFrame:
        own = rows.where(F.col("phash").rlike(HASH)).select(F.lower("phash").alias(name)).distinct()
        value = F.conv(F.col(name), 16, -10).cast("long")
        return own.select(F.lit(0).cast("long").alias("bucket"), name, value.alias(number), value.alias(whole))

    probes, index = told(left, "phash", "x", "own"), told(right, "ref_phash", "y", "other")
    n_left, n_right = (0, 0) if banded else (probes.count(), index.count())
    widths = [w for _, w in _cuts(64, _parts(64, limit, max(n_right, 1)))]
    if not banded and n_right <= PAIRS_PER_ROW * planned_radii(widths, limit, n_right, [2.0**-w for w in widths])[1]:
        found = _compared(probes, index, limit, n_left, n_right)
    else:
        found = _met(probes, index, 64, limit, DEPTH).distinct()
    number = lambda c: F.conv(F.col(c), 16, -10).cast("long")
    return found.select("phash", "ref_phash", F.bit_count(number("phash").bitwiseXOR(number("ref_phash"))).alias("distance"))


def hamming_matches(probes: DataFrame, references: DataFrame, limit: int, banded: bool = False) -> DataFrame:
    """probe, ref, distance of all pairs (probe, phash) and (ref, phash) within ``limit`` bits, up to 31."""
    near = near_hashes(probes, references, limit, banded)
    return probes.select("probe", F.lower("phash").alias("phash")).join(near, "phash").join(references.select("ref", F.lower("phash").alias("ref_phash")), "ref_phash").select("probe", "ref", "distance").distinct()


def best_match(matches: DataFrame) -> DataFrame:
    """The nearest reference of each probe; the smaller reference wins ties."""
    return matches.groupBy("probe").agg(F.min_by("ref", F.struct("distance", "ref")).alias("ref"), F.min("distance").alias("distance"))


def greedy_clusters(hashes: DataFrame, limit: int = CONFIDENT, cap: int = CLUSTER_CAP) -> DataFrame:
    """group, idx, cluster: each item joins the first cluster whose first hash is within ``limit``, else opens one.

    The rule depends on the order, so each group folds in one Arrow batch; a
    group is one document's images. Clusters past ``cap`` are kept and numbered,
    with ``scanned`` false.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[int] = []
        out = []
        for phash in (int(h, 16) for h in pdf.sort_values("idx")["phash"]):
            at = next((i for i, h in enumerate(heads) if (h ^ phash).bit_count() <= limit), len(heads))
            if at == len(heads):
                heads.append(phash)
            out.append(at)
        pdf = pdf.sort_values("idx")[["group", "idx"]].copy()
        pdf["cluster"] = out
        pdf["scanned"] = pdf["cluster"] < cap
        return pdf

    return hashes.select("group", "idx", "phash").groupBy("group").applyInPandas(fold, "group long, idx long, cluster int, scanned boolean")


def similar_components(items: DataFrame, limit: int = MERGE) -> DataFrame:
    """node, component over (key, phash): linked within ``limit`` bits, transitively; equal hashes are one node until the end."""
    rows = items.where(F.col("phash").rlike(HASH)).select("key", F.lower("phash").alias("phash"))
    first = rows.groupBy("phash").agg(F.min("key").alias("rep"))
    near = near_hashes(first, first, limit).where("phash <= ref_phash")
    edges = near.join(first, "phash").join(first.select(F.col("phash").alias("ref_phash"), F.col("rep").alias("ref")), "ref_phash")
    found = connected_components(edges, "rep", "ref").withColumnRenamed("node", "rep")
    return rows.join(first, "phash").join(found, "rep").select(F.col("key").alias("node"), "component")


def visually_merged(items: DataFrame, limit: int = MERGE) -> DataFrame:
    """node, component over (key, phash, logo, brand): alike within ``limit`` bits, or of one logo entity, or of one brand read.

    What shares a logo or a brand hangs on its first item, so no pairs are made.
    """
    alike = similar_components(items, limit).select(F.col("node").alias("a"), F.col("component").alias("b"))
    edges = alike.unionByName(items.select(F.col("key").alias("a"), F.col("key").alias("b")))
    for shared in ("logo", "brand"):
        first = items.where(F.col(shared).isNotNull()).groupBy(shared).agg(F.min("key").alias("b"))
        edges = edges.unionByName(items.join(first, shared).select(F.col("key").alias("a"), "b"))
    return connected_components(edges)


def near_any(items: DataFrame, references: DataFrame, limit: int = CONFIDENT) -> DataFrame:
    """The items (phash) within ``limit`` bits of any reference (phash)."""
    near = near_hashes(items, references, limit).select(F.col("phash").alias("_near")).distinct()
    return items.join(near, F.lower(items["phash"]) == near["_near"], "left_semi")


def merged_clusters(members: DataFrame) -> DataFrame:
    """Per component: highest confidence, any flag, all places, the nearest logo, the primary member, what was read first and each text once in order; numbered from 0 by first place."""
    primary = F.struct(F.col("confidence"), -F.col("idx"))
    read = F.array_sort(F.collect_list(F.when(F.col("ocr").isNotNull(), F.struct("idx", "ocr"))))
    merged = members.groupBy("component").agg(
        F.max("confidence").alias("confidence"),
        F.bool_or("flagged").alias("flagged"),
        F.array_join(F.array_sort(F.collect_set("idx")), ",").alias("indices"),
        F.max_by("idx", primary).alias("primary_idx"),
        F.min("logo_distance").alias("logo_distance"),
        F.min_by("ocr", F.when(F.col("ocr").isNotNull(), F.col("idx"))).alias("ocr"),
        F.array_join(F.array_distinct(F.transform(read, lambda x: x["ocr"])), ",").alias("ocrs"),
        F.min("idx").alias("first"),
    )
    return running(ranked(merged, "first"), F.sum, number=F.lit(1)).withColumn("number", F.col("number") - 1).drop("first", "_at")


def mandatory_images(matches: DataFrame, entities: DataFrame, limit: int = CONFIDENT) -> DataFrame:
    """probe of the matches (probe, ref, distance, entity_id) that must be covered: within ``limit`` bits of a logo whose entity (entity_id, status) is approved."""
    approved = entities.where("status = 'approved'").select("entity_id").distinct()
    return matches.where(F.col("distance") <= limit).join(approved, "entity_id", "left_semi").select("probe").distinct()


def identity_rules(rows: DataFrame, ocr_match: Column, own_firm: Column) -> DataFrame:
    """Adds identity, confidence and judgment from (flagged, confidence, logo_distance).

    A dictionary match in the text read, or a confident logo, overrides the
    model and raises confidence to 0.95; the firm's own name overrides all.
    What stays uncertain asks for a person's judgment.
    """
    confident = F.coalesce(F.col("logo_distance") <= CONFIDENT, F.lit(False))
    uncertain = F.coalesce((F.col("logo_distance") > CONFIDENT) & (F.col("logo_distance") <= UNCERTAIN), F.lit(False))
    matched, own = F.coalesce(ocr_match, F.lit(False)), F.coalesce(own_firm, F.lit(False))
    raised = F.when(matched | confident, F.greatest("confidence", F.lit(0.95).cast("double"))).otherwise(F.col("confidence"))
    identity = (F.col("flagged") | matched | confident) & ~own
    return rows.select(*[c for c in rows.columns if c != "confidence"], raised.alias("confidence"), identity.alias("identity"), (~own & (uncertain | (raised.between(0.3, 0.7) & ~identity))).alias("judgment"))


def memo_misses(wanted: DataFrame, memo: DataFrame) -> DataFrame:
    """(run_id, content_key) without a remembered verdict, each once."""
    return wanted.select("run_id", "content_key").distinct().join(memo.select("run_id", "content_key"), ["run_id", "content_key"], "left_anti")


def skipped_clusters(clusters: DataFrame, cap: int = CLUSTER_CAP) -> DataFrame:
    """group, shown, skipped: how many clusters the cap leaves out."""
    return clusters.groupBy("group").agg(F.countDistinct("cluster").alias("n")).select("group", F.least("n", F.lit(cap)).alias("shown"), F.greatest(F.col("n") - cap, F.lit(0)).alias("skipped"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
