"""Claims on runs as leases: one keyed state with timers, so that two consumers never hold one run.

A request (run_id, consumer, kind, ts, seq) submits, claims, releases or
completes a run. A claim of a waiting run is granted for a lease; the holder's
own claim renews it; another's is refused until the lease is over. A lease that
nobody ends goes back by a timer when event time has passed it, or by the next
claim if that comes first. Only the holder, and only within the lease, releases
or completes; a complete run waits again when it is submitted again.

Requests of a batch count in order of ts and seq; a request that comes in a
later batch with an earlier ts counts as of the last one's time, so time never
goes back for a run and no grant is taken back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.streaming.runs import run_available

WAITING, HELD, COMPLETE = "waiting", "held", "complete"
_STATE = "status string, holder string, since_ms long, until_ms long, at_ms long"
#: ``seq`` is the request's number, or the negative end of a lease that ran out.
OUT = "run_id long, seq long, consumer string, outcome string, since_ms long, until_ms long"
LEASE_MS = 86_400_000


class Leases(StatefulProcessor):
    """Outcomes of the requests of each run; its state is one row."""

    def __init__(self, lease_ms: int = LEASE_MS):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("lease", _STATE)

    def close(self) -> None:
        pass

    def _load(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, None, None, None, None]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, holder, since, until, at = self._load()
        timer, out = until if status == HELD else None, []
        for consumer, kind, ms, seq in sorted((tuple(r) for frame in rows for r in frame[["consumer", "kind", "ms", "seq"]].itertuples(index=False)), key=lambda r: (r[2], r[3])):
            at = int(ms) if at is None else max(at, int(ms))
            if status == HELD and until <= at:
                out.append((-until, holder, "expired", since, until))
                status, holder, since, until = WAITING, None, None, None
            if kind == "submit":
                outcome = "known" if status in (WAITING, HELD) else "submitted"
                status = WAITING if outcome == "submitted" else status
            elif kind == "claim" and status == WAITING:
                status, holder, since, until, outcome = HELD, consumer, at, at + self.lease_ms, "granted"
            elif kind == "claim" and status == HELD and holder == consumer:
                until, outcome = at + self.lease_ms, "renewed"
            elif kind in ("release", "complete") and status == HELD and holder == consumer:
                out.append((int(seq), consumer, f"{kind}d", since, at))
                status, holder, since, until = WAITING if kind == "release" else COMPLETE, None, None, None
                continue
            else:
                outcome = "refused"
            out.append((int(seq), consumer, outcome, since if outcome in ("granted", "renewed") else None, until if outcome in ("granted", "renewed") else None))
        self._save(status, holder, since, until, at, timer)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, holder, since, until, at = self._load()
        out = []
        if status == HELD and until <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((-until, holder, "expired", since, until))
            self._save(WAITING, None, None, None, max(at, until), None)
        yield self._frame(key, out)

    def _save(self, status, holder, since, until, at, timer) -> None:
        if timer is not None and timer != until:
            self.handle.deleteTimer(timer)
        if status == HELD and timer != until:
            self.handle.registerTimer(until)
        self.state.update((status, holder, since, until, at))

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        seqs, consumers, outcomes, since, until = zip(*rows) if rows else ((), (), (), (), ())
        return pd.DataFrame({
            "run_id": pd.Series([key[0]] * len(rows), dtype="int64"), "seq": pd.Series(seqs, dtype="int64"), "consumer": pd.Series(consumers, dtype=object), "outcome": pd.Series(outcomes, dtype=object),
            "since_ms": pd.Series(since, dtype="Int64"), "until_ms": pd.Series(until, dtype="Int64"),
        })


def outcomes(requests: DataFrame, watermark: str = "1 hour", lease_ms: int = LEASE_MS) -> DataFrame:
    """The stream of outcomes of a stream of requests (run_id, consumer, kind, ts, seq)."""
    rows = requests.withWatermark("ts", watermark).select("run_id", F.col("consumer").cast("string").alias("consumer"), "kind", F.unix_millis("ts").alias("ms"), "seq", "ts")
    return rows.groupBy("run_id").transformWithStateInPandas(Leases(lease_ms), OUT, "Update", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def granted(requests: DataFrame, watermark: str = "1 hour", lease_ms: int = LEASE_MS) -> DataFrame:
    """The outcomes of all requests that are there, one row for each."""
    with keyed_state(requests.sparkSession):
        return run_available(outcomes(requests, watermark, lease_ms), ["run_id", "seq"], ["until_ms"], "leases")
