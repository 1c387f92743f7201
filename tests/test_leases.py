"""Leases: no run has two holders, a lease that runs out goes back by its timer, and a replay gives the same outcomes."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from corvane.streaming import leases

SCHEMA = "run_id long, consumer string, kind string, ts timestamp, seq long"
START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def written(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r, c, k, START + dt.timedelta(hours=h), s) for r, c, k, h, s in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def run(spark, stream, folder, watermark="1 hour", dies_at=None):
    """All outcomes, each batch written once; the first time, the given batch fails after its write."""

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/part={number}")
        if number == dies_at:
            raise RuntimeError("killed")

    with leases.keyed_state(spark):
        query = leases.outcomes(stream, watermark, 24 * HOUR).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
        if dies_at is None:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="killed"):
                query.awaitTermination()
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    hours = lambda ms: None if ms is None else (ms - zero) / HOUR
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted(((r["run_id"], r["seq"] if r["outcome"] != "expired" else -1, r["consumer"], r["outcome"], hours(r["since_ms"]), hours(r["until_ms"])) for r in rows), key=str)


def test_a_lease_ends_by_its_timer(spark, tmp_path):
    batches = [
        [(1, "a", "submit", 0, 1), (1, "a", "claim", 1, 2), (1, "b", "claim", 2, 3), (2, "a", "claim", 2, 4), (3, "a", "submit", 2, 5), (3, "b", "claim", 3, 6)],
        [(9, "a", "submit", 100, 7)],  # event time passes the leases
        [(9, "a", "claim", 101, 8), (1, "b", "claim", 102, 9), (1, "b", "complete", 103, 10), (1, "a", "claim", 104, 11), (1, "a", "submit", 105, 12), (1, "a", "claim", 106, 13), (1, "b", "release", 107, 14)],
    ]
    out = run(spark, written(spark, str(tmp_path), batches), str(tmp_path))
    want = [
        (1, 1, "a", "submitted", None, None), (1, 2, "a", "granted", 1, 25), (1, 3, "b", "refused", None, None), (2, 4, "a", "refused", None, None), (3, 5, "a", "submitted", None, None), (3, 6, "b", "granted", 3, 27),
        (1, -1, "a", "expired", 1, 25), (3, -1, "b", "expired", 3, 27), (9, 7, "a", "submitted", None, None), (9, 8, "a", "granted", 101, 125), (1, 9, "b", "granted", 102, 126), (1, 10, "b", "completed", 102, 103),
        (1, 11, "a", "refused", None, None), (1, 12, "a", "submitted", None, None), (1, 13, "a", "granted", 106, 130), (1, 14, "b", "refused", None, None),
    ]
    assert out == sorted(want, key=str)


@pytest.mark.parametrize("dies_at", [None, 2])
def test_no_run_has_two_holders(spark, tmp_path, dies_at):
    """Requests in files out of order, with a batch that is replayed: leases of one run do not overlap, and no outcome is lost or doubled."""
    rng = random.Random(6)
    rows = [(rng.randrange(6), rng.choice("abc"), rng.choice(["submit", "claim", "claim", "claim", "release", "complete"]), rng.randrange(400), s) for s in range(300)]
    batches = [rows[i::5] for i in range(5)]
    folder = str(tmp_path)
    stream = written(spark, folder, batches)
    if dies_at is not None:
        run(spark, stream, folder, "500 hours", dies_at)
    out = run(spark, stream, folder, "500 hours")
    assert sorted(r[1] for r in out if r[3] != "expired") == list(range(300))
    held = {}
    for run_id, seq, consumer, outcome, since, until in out:
        if outcome in ("granted", "renewed"):
            end = held.get((run_id, since, consumer), 0)
            held[run_id, since, consumer] = max(end, until)
    for run_id, seq, consumer, outcome, since, until in out:
        if outcome in ("released", "completed"):
            held[run_id, since, consumer] = until
    spans = sorted((r, s, u) for (r, s, _), u in held.items())
    assert len(spans) > 20 and all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    if dies_at is None:
        again = str(tmp_path / "again")
        assert run(spark, written(spark, again, batches), again, "500 hours") == out
