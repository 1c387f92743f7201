"""Run states over a stream of events, with results equal to the batch queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.lifecycle import RESTING, STALE_MINUTES, status_of
from corvane.operators.upkeep import entities_created
from corvane.sources.shared import new_folder

_STATE = "ts timestamp, event_id long, status string"
_OUT = "user_id long, status string, event_id long, updated_at timestamp"


def events_stream(spark: SparkSession, folder: str, name: str = "events", per_batch: int | None = 16) -> DataFrame:
    """The event table as a file stream, so many files to a batch; None: all that are there, for what depends on the order of rows."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)
    # A single file is named by a pattern in its folder, as streams list folders.
    rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if _is_file(spark, path) else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def replay_watermark(spark: SparkSession, folder: str, name: str = "events") -> str:
    """A watermark longer than the table's time span: in a replay no event is late, in whatever order its files come."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = spark.read.parquet(f"{folder}/{name}.parquet").agg((F.max(seconds) - F.min(seconds)).alias("span")).first()["span"]
    return f"{(span or 0) + 86_400} seconds"


def run_states(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A row for each user and batch with the state of the run's latest event so far (ties by event id).

    State holds one row per run. It goes when event time has passed the run's
    last event by 30 days.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.getOption
        for frame in frames:
            at = frame.sort_values(["ts", "event_id"]).iloc[-1]
            row = (at["ts"].to_pydatetime(), int(at["event_id"]), at["status"])
            best = row if best is None or row[:2] > tuple(best)[:2] else tuple(best)
        state.update(tuple(best))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(best[0]).timestamp() * 1000), state.getCurrentWatermarkMs()) + 30 * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "status": [best[2]], "event_id": [best[1]], "updated_at": [best[0]]})

    rows = events.select("user_id", "ts", "event_id", status_of(F.col("event_type")).alias("status")).withWatermark("ts", watermark)
    return rows.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Process what is there, upsert each batch as its own part, and read the newest row of each key."""
    spark = stream.sparkSession
    target, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        # A replayed batch overwrites its own part: exactly once.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(target)
    newest = F.struct(*order, "batch")
    return rows.groupBy(*keys).agg(*[F.max_by(c, newest).alias(c) for c in stream.columns if c not in keys])


def grow_dictionary(stream: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """(surface, entity_type, token) of all new surfaces of a stream (surface, entity_type).

    Each batch meets the dictionary as the batches before it have left it, and
    enters what it lacks. A replayed batch sees the same state and overwrites
    its own part.
    """
    spark = stream.sparkSession
    target, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        known = dictionary.select("surface", "token")
        if number:
            known = known.unionByName(spark.read.parquet(target).where(F.col("part") < number).select("surface", "token"))
        entities_created(known, batch).write.mode("overwrite").parquet(f"{target}/part={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("surface", "entity_type", "token")


def stale(states: DataFrame, now, minutes: int = STALE_MINUTES) -> DataFrame:
    """Runs at work that had no event for the limit."""
    return states.where(~F.col("status").isin(*RESTING) & (F.col("updated_at") < F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES")))


def windowed_counts(events: DataFrame, width: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """user_id, start, end, n: a user's events without a pause of ``gap``; the state keeps every session, so none is late."""
    window = F.session_window("ts", gap)
    return events.groupBy("user_id", window).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there and read the whole result as of the last batch."""
    spark = stream.sparkSession
    target, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/part={number}")

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(target)
    last = rows.agg(F.max("part").alias("part")).first()["part"]
    return rows.where(F.col("part") == last).drop("part")


def on_time_and_late(events: DataFrame, delay: str, name: str) -> DataFrame:
    """All events with ``late``: whether they came after event time had passed them by ``delay``.

    Event time is that of the batches before, as each has left it; the on-time
    rows and the late ones are two sides of one output, none is dropped. A
    replayed batch reads the same marks and overwrites its own part.
    """
    spark = events.sparkSession
    target, marks, checkpoint = (new_folder(spark, f"{name}-{kind}") for kind in ("rows", "marks", "checkpoint"))

    def write(batch: DataFrame, number: int) -> None:
        seen = spark.read.parquet(marks).where(F.col("part") < number).agg(F.max("ts").alias("ts")).first()["ts"] if number else None
        passed = F.lit(seen).cast("timestamp") - F.expr(f"interval {delay}")
        batch.withColumn("late", F.coalesce(F.col("ts") < passed, F.lit(False))).write.mode("overwrite").parquet(f"{target}/part={number}")
        batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{marks}/part={number}")

    events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).drop("part")
