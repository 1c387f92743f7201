"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name; Spark reads only the columns and row groups a query needs."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
