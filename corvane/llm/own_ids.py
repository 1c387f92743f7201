"""Ids of their own for rows that share an id, or have none, but differ in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialize

#: Stands for a null id and sorts after all others; where a document really has this id, by_own_ids tells them apart.
NO_ID = (1 << 63) - 1
_KEY = ["_own_doc", "_own_null", "_own_h1", "_own_h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.withColumns(dict(zip(_KEY, (doc, F.col("doc_id").isNull(), F.xxhash64("text"), F.xxhash64(F.lit("text"), "text")))))


def by_own_ids(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(docs)``, whose verdicts go by doc_id, with each id and text a document of its own.

    Own ids keep the order of doc_id (nulls last), then of a hash of the text;
    equal rows share one. The result has the rows' real ids again. Where every
    id has one text, ids are their own, and texts are not shuffled for new ones.
    """
    keys = _keyed(docs).select(*_KEY)
    several = keys.groupBy("_own_doc").agg(F.min("_own_h1").alias("low"), F.max("_own_h1").alias("high"), F.bool_and("_own_null").alias("without"))
    if several.where((F.col("low") != F.col("high")) | ((F.col("_own_doc") == NO_ID) & ~F.col("without"))).isEmpty():
        return run(docs)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are in order and each is sorted, so the ids that Spark counts up in them follow the keys.
    ranges = keys.distinct().repartitionByRange(partitions, *_KEY).sortWithinPartitions(*_KEY)
    own = materialize(ranges.withColumn("_own_id", F.monotonically_increasing_id()), "own-ids")
    marked = _keyed(docs).join(own.hint("merge"), _KEY)
    rows = run(marked.select(*[F.col("_own_id").alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns]))
    kind = docs.schema["doc_id"].dataType if rows.columns == docs.columns else "long"
    real = own.select(F.col("_own_id").alias("doc_id"), F.when(~F.col("_own_null"), F.col("_own_doc")).cast(kind).alias("_own_real"))
    return rows.join(real.hint("merge"), "doc_id").select(*[F.col("_own_real").alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in rows.columns])
