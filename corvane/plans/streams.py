"""Queries that run a stream over what is there; results equal the batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans import governance
from corvane.plans.fixtures import literal, values
from corvane.sources.tables import table
from corvane.streaming import leases, runs


def _states(spark, folder):
    rows = runs.run_states(runs.events_stream(spark, folder), runs.replay_watermark(spark, folder))
    return runs.run_available(rows, ["user_id"], ["updated_at", "event_id"], "run-states")


def stream_run_status(spark, folder):
    return _states(spark, folder).select("user_id", "status", "event_id")


def stream_stale(spark, folder):
    states = _states(spark, folder)
    now = table(spark, folder, "events").agg(F.max("ts").alias("ts")).first()["ts"]
    return runs.stale(states, now).select("user_id", "status")


def stream_windowed_counts(spark, folder):
    counts = runs.windowed_counts(runs.events_stream(spark, folder), watermark=runs.replay_watermark(spark, folder))
    return runs.run_available(counts, ["start", "event_type"], ["n"], "window-counts").select(F.col("start").cast("date").alias("day"), "event_type", "n")


def stream_dictionary(spark, folder):
    """Clients named in a stream, entered into the dictionary as they come; which number each gets depends on that, all numbers together do not."""
    named = runs.events_stream(spark, folder).select(F.concat(F.lit("Client "), F.col("user_id") % 40).alias("surface"), F.lit("CLIENT_NAME").alias("entity_type"))
    grown = runs.grow_dictionary(named, literal(spark, "dictionary"), "dictionary")
    return grown.groupBy("entity_type").agg(F.countDistinct("surface").alias("surfaces"), F.array_join(F.array_sort(F.collect_list("token")), ",").alias("tokens"))


def stream_sessions(spark, folder):
    """Each user's sessions: events with less than six hours between them."""
    rows = runs.run_complete(runs.sessions(runs.events_stream(spark, folder)), "sessions")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _requests(events):
    """Users are runs; what happens to them are requests of one of three consumers."""
    kind = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "release").otherwise("claim")
    return events.select(F.col("user_id").alias("run_id"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("consumer"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))


def stream_leases(spark, folder):
    """What became of every request, all that are there as one batch; leases that run out are told apart."""
    rows = leases.granted(_requests(runs.events_stream(spark, folder, per_batch=None)), runs.replay_watermark(spark, folder))
    return rows.where("outcome <> 'expired'").select("run_id", "seq", "consumer", "outcome", "since_ms", "until_ms")


#: The rule request by request: the state that each one finds, an ended lease counting as waiting.
_LEASES = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT user_id AS run_id, event_id AS seq, 'c' || (event_id % 3) AS consumer, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'release' ELSE 'claim' END AS kind, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS p FROM events),
w(run_id, p, seq, consumer, outcome, status, holder, since, until, told) AS (
  SELECT run_id, 0::BIGINT, 0::BIGINT, '', '', 'none', NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT run_id FROM q)
  UNION ALL
  SELECT run_id, p, seq, consumer, outcome,
    CASE outcome WHEN 'submitted' THEN 'waiting' WHEN 'granted' THEN 'held' WHEN 'released' THEN 'waiting' WHEN 'completed' THEN 'complete' ELSE status END,
    CASE WHEN outcome = 'granted' THEN consumer WHEN outcome IN ('released', 'completed') THEN NULL ELSE holder END,
    CASE WHEN outcome = 'granted' THEN ms WHEN outcome IN ('released', 'completed') THEN NULL ELSE since END,
    CASE WHEN outcome IN ('granted', 'renewed') THEN ms + {leases.LEASE_MS} WHEN outcome IN ('released', 'completed') THEN NULL ELSE until END,
    CASE WHEN outcome = 'granted' THEN ms WHEN outcome IN ('renewed', 'released', 'completed') THEN since END
  FROM (SELECT *, CASE WHEN kind = 'submit' THEN CASE WHEN status IN ('waiting', 'held') THEN 'known' ELSE 'submitted' END WHEN kind = 'claim' AND status = 'waiting' THEN 'granted' WHEN kind = 'claim' AND status = 'held' AND holder = consumer THEN 'renewed' WHEN kind IN ('release', 'complete') AND status = 'held' AND holder = consumer THEN kind || 'd' ELSE 'refused' END AS outcome
    FROM (SELECT w.run_id, q.p, q.seq, q.consumer, q.kind, q.ms, CASE WHEN over THEN 'waiting' ELSE w.status END AS status, CASE WHEN over THEN NULL ELSE w.holder END AS holder, CASE WHEN over THEN NULL ELSE w.since END AS since, CASE WHEN over THEN NULL ELSE w.until END AS until
      FROM (SELECT w.*, coalesce(w.status = 'held' AND w.until <= q.ms, false) AS over FROM w JOIN q ON q.run_id = w.run_id AND q.p = w.p + 1) w JOIN q ON q.run_id = w.run_id AND q.p = w.p + 1)))"""

_SIX_HOURS = 6 * 3600 * 1000000
ORACLE = {
    "stream_sessions": (
        f"SELECT user_id, min(us) AS start_us, max(us) + {_SIX_HOURS} AS end_us, count(*)::BIGINT AS n FROM (SELECT user_id, us, sum(CASE "
        f"WHEN us - before < {_SIX_HOURS} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, "
        f"epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, session"
    ),
    "stream_leases": (
        f"{_LEASES} SELECT w.run_id, w.seq, w.consumer, outcome, told AS since_ms, CASE WHEN outcome IN ('granted', 'renewed') THEN until "
        f"WHEN outcome IN ('released', 'completed') THEN q.ms END AS until_ms FROM w JOIN q USING (run_id, p) WHERE p > 0"
    ),
    "stream_dictionary": "SELECT entity_type, count(DISTINCT surface)::BIGINT AS surfaces, string_agg(token, ',' ORDER BY token) AS tokens FROM (" + governance.allocated("SELECT DISTINCT 'Client ' || (user_id % 40) AS surface, 'CLIENT_NAME' AS kind, 'CLIENT' AS p FROM events", f"(SELECT list(token) FROM {values('dictionary')} d)") + ") t GROUP BY entity_type",
    "stream_run_status": governance.ORACLE["run_status_latest"],
    "stream_stale": governance.ORACLE["stale_runs"],
    "stream_windowed_counts": "SELECT ts::DATE AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in ORACLE}
