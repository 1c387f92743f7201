"""Run states, staleness, roll-ups and text extraction from model replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States in which a run rests, and minutes without an update after which others are stale.
RESTING = ("pending", "awaiting_review", "completed", "completed_with_issues", "failed", "rejected")
STALE_MINUTES = 15
# USD per thousand tokens, in and out.
PRICE_IN, PRICE_OUT = 0.003, 0.015


def status_of(event: Column) -> Column:
    """An event's type as the state that it brings a run to."""
    return F.when(event == "signup", "pending").when(event == "view", "detecting").when(event == "click", "awaiting_review").when(event == "purchase", "completed").otherwise("failed")


def latest(events: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The named columns of each key's last row; a partial aggregate, so hot keys stay small."""
    return events.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in columns])


def stale(runs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Runs at work whose last update is older than the limit."""
    return runs.where(~F.col("status").isin(*RESTING) & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def oldest(rows: DataFrame, state: str, order: list[str]) -> DataFrame:
    """The head of the queue of one state."""
    return rows.where(F.col("status") == state).orderBy(*order).limit(1)


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """USD, six decimals; null counts are none."""
    return F.round(F.coalesce(tokens_in, F.lit(0)) / 1000 * PRICE_IN + F.coalesce(tokens_out, F.lit(0)) / 1000 * PRICE_OUT, 6)


def final_status(flags: DataFrame, key: str) -> DataFrame:
    """completed, or completed_with_issues if any flag is blocking."""
    blocked = F.bool_or(F.col("severity") == "blocking")
    return flags.groupBy(key).agg(F.when(blocked, "completed_with_issues").otherwise("completed").alias("status"))


def chained(runs: DataFrame) -> DataFrame:
    """One tagging run for each completed sanitization run that asks for it and has none yet."""
    due = runs.where("agent = 'sanitization' and status = 'completed' and chain_to = 'tagging'")
    have = runs.where("agent = 'tagging'").select(F.col("parent").alias("run_id")).distinct()
    return due.join(have, "run_id", "left_anti").select(F.col("run_id").alias("parent"), F.lit("tagging").alias("agent"), F.lit("pending").alias("status"))


_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _last_object(text: str) -> dict | None:
    for block in reversed(_FENCED.findall(text)):
        if (found := _object(block.strip())) is not None:
            return found
    wide = text[text.find("{") : text.rfind("}") + 1]
    if not wide.startswith("{") or (found := _object(wide)) is not None:
        return found if wide.startswith("{") else None
    # An answer may repeat its schema first and hang the rest on with a comma.
    try:
        first, end = json.JSONDecoder().raw_decode(wide)
    except ValueError:
        return None
    more = wide[end:].strip()
    second = _object("{" + more[1:]) if more.startswith(",") else None
    return first | second if isinstance(first, dict) and second is not None else None


@F.pandas_udf(T.StringType())
def last_json(texts: pd.Series) -> pd.Series:
    """The last fenced block that parses as an object, else the widest braces, else two objects glued by a comma as one, as JSON text; null if none parses.

    Whether a whole text is one JSON object is not told by Spark's functions, which pass over what follows, hence Arrow batches.
    """
    found = [None if t is None else _last_object(t) for t in texts]
    return pd.Series([None if x is None else json.dumps(x) for x in found], dtype=object)

