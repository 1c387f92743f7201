"""The near-hash join against all pairs, with uneven parts and buckets that are cut again, and how few pairs it meets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import similarity


def hexes(rng, n, hot):
    """Hashes of which a part may be one value in most rows, and near copies of some."""
    base = [rng.getrandbits(64) if i % 3 or not hot else (rng.getrandbits(40) << 24) | 0xABCDEF for i in range(n)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 13))) for x in base for _ in range(2)]
    return [f"{x:016x}" for x in base + near]


@pytest.mark.parametrize("limit,hot,bucket", [(0, False, 4096), (4, True, 8), (10, True, 9), (15, False, 4096)])
def test_all_pairs_within_the_limit(spark, monkeypatch, limit, hot, bucket):
    monkeypatch.setattr(similarity, "HOT_BUCKET", bucket)
    rng = random.Random(limit)
    left, right = hexes(rng, 10, hot), hexes(rng, 20, hot)
    right += left[::3] + [left[0].upper()]
    frame = lambda rows: spark.createDataFrame([(h, 1) for h in [*rows, None, "xyz", ""]], "phash string, bucket int")
    rows = similarity.near_hashes(frame(left), frame(right), limit).collect()
    got = {(r["phash"], r["ref_phash"]): r["distance"] for r in rows}
    differ = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == {(a, b.lower()): differ(a, b) for a in left for b in right if differ(a, b) <= limit} and len(got) == len(rows)


@pytest.mark.parametrize("limit", [4, 10])
def test_few_pairs_are_met(spark, monkeypatch, limit):
    """200 000 hashes, a third of which share 20 bits: under two in a hundred of all pairs with 50 queries is compared."""
    met = []
    compare = similarity._near_pairs

    def counted(asked, keyed, key, limit):
        met.append(asked.join(keyed, key).count())
        return compare(asked, keyed, key, limit)

    monkeypatch.setattr(similarity, "_near_pairs", counted)
    hashes = spark.range(200_000).select(F.lpad(F.lower(F.hex(F.xxhash64("id"))), 16, "0").alias("phash"), "id")
    shared = F.concat(F.lit("abcde"), F.substring("phash", 6, 11))
    hashes = hashes.select(F.when(F.col("id") % 3 == 0, shared).otherwise(F.col("phash")).alias("phash"), "id")
    queries = hashes.where("id % 4000 = 0")
    found = similarity.near_hashes(queries, hashes, limit)
    assert found.where("phash = ref_phash").count() == 50
    assert sum(met) < 0.02 * 50 * 200_000


def test_radii_lose_nothing():
    for widths in ([16, 16, 16, 16], [21, 21, 22], [13] * 5, [32, 32]):
        for limit in range(32):
            radii, _ = similarity.planned_radii(widths, limit, 10**6, [2.0**-w for w in widths])
            # Were all parts beyond their radius, more than the limit would differ.
            assert sum(r + 1 for r in radii) == limit + 1
    uneven, _ = similarity.planned_radii([16] * 4, 10, 10**6, [0.3, 2.0**-16, 2.0**-16, 2.0**-16])
    assert uneven[0] < min(uneven[1:])
