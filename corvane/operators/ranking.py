"""Running sums and maxima over a whole table's order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import materialize

#: Bits of ``_at`` below the number of its partition.
_PLACE_BITS = 33


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in range partitions, sorted, with ``_at`` that follows the order; written, so that it stands."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")


def running(rows: DataFrame, fold, **values: Column) -> DataFrame:
    """Adds, for each value, its ``fold`` (F.sum or F.max) over all rows up to this one in the order of ``_at``.

    Each range partition folds on its own; what lies before it comes from one
    row for each partition, which is all that is broadcast.
    """
    own = rows.withColumn("_part", F.shiftright("_at", _PLACE_BITS)).withColumns({f"_v_{name}": value for name, value in values.items()})
    ends = own.groupBy("_part").agg(*[fold(f"_v_{name}").alias(f"_b_{name}") for name in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_part", *[fold(f"_b_{name}").over(earlier).alias(f"_b_{name}") for name in values])
    so_far = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = own.withColumns({f"_v_{name}": fold(f"_v_{name}").over(so_far) for name in values}).join(F.broadcast(before), "_part", "left")
    both = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if fold is F.sum else (lambda a, b: F.greatest(a, b))
    return local.select(*rows.columns, *[both(F.col(f"_v_{name}"), F.col(f"_b_{name}")).alias(name) for name in values])
