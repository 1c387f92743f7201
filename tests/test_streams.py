from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.plans import streams
from tests.harness import assert_same, connection


@pytest.fixture(scope="module")
def many_files(spark, small, tmp_path_factory):
    """The events in more files than a batch takes, the newest first; odd users have none in the newest seven tenths."""
    folder, events = str(tmp_path_factory.mktemp("events")), spark.read.parquet(f"{small}/events.parquet")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    events.where((F.col("user_id") % 2 == 0) | (F.col("ts") < first + (last - first) * 0.3)).repartitionByRange(40, F.col("ts").desc()).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(streams.ORACLE))
def test_streams_of_many_unordered_files(spark, many_files, name):
    assert_same(streams.QUERIES[name](spark, many_files), connection(many_files), streams.ORACLE[name])
