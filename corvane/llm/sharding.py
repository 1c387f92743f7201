"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by the leading bits of a hash of the document. A
bucket over the byte limit splits on one more bit; the others stay. So a shard
is the shallowest bucket that fits, whatever the sizes below it.

Bucket sizes come from sums over cells: first cells of about an even split,
summed at every depth above them; then, only inside cells that are still too
large, cells of ``ROUND_BITS`` more bits, round by round until every bucket
fits or the hash has no more bits. The directory is a table and is joined,
never collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialize

SHARD_BYTES = 1 << 20
HASH_BITS = 60
#: Bits that oversized cells split on in one round.
ROUND_BITS = 16


def _hash() -> Column:
    """60 bits of the md5 of the id, or of the text where the id is null."""
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and h, the document's hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _hash().alias("h"))


def _cell(bits: int):
    return F.shiftright("h", HASH_BITS - bits)


def _shards(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For cells of ``high`` bits: the shallowest bucket from ``low`` bits on that fits; one of all the hash's bits always does."""
    up = F.lit(high) - F.col("depth")
    levels = cells.select("cell", "size", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), up))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("size").alias("shard_bytes")).where((F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS))
    return levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("shard")).select("cell", "shard.*")


def assign(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (its hash bits as text), depth, shard_bytes (all that the shard holds).

    One document, or several of one hash, over the limit cannot be parted and
    end in a bucket of all ``HASH_BITS`` bits. Null texts count no bytes; rows
    with one id share a shard; rows with null ids are placed by their text; an
    empty table gives no rows. Other columns are not read.
    """
    return _assigned(docs, shard_bytes).drop("h")


def _assigned(docs: DataFrame, shard_bytes: int) -> DataFrame:
    rows = materialize(hashed(docs), "hashed")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    low, high, parts = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / shard_bytes)))) + 1), []
    while True:
        rows = rows.withColumn("cell", _cell(high))
        cells = materialize(rows.groupBy("cell").agg(F.sum("n_bytes").alias("size")), "cells")
        placed = materialize(_shards(cells, low, high, shard_bytes), "directory")
        parts.append(rows.join(placed, "cell"))
        left = cells.join(placed, "cell", "left_anti").select("cell")
        if high == HASH_BITS or left.isEmpty():
            break
        rows = materialize(rows.join(left, "cell", "left_semi").drop("cell"), "oversized")
        low, high = high + 1, min(HASH_BITS, high + ROUND_BITS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.call_function("lpad", F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "n_bytes", "h", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> str:
    """Write the documents, with all their columns, as one folder per shard; rows meet their shard by their hash, null ids too.

    Returns the name of the column that the folders tell: ``shard``, or, where
    the documents have that already in any case, the first of ``shard_``,
    ``shard__`` … that they lack.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    shards = _assigned(docs, shard_bytes).select("h", F.col("shard").alias("prefix")).distinct()
    rows = docs.select(_hash().alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(shards, "h")
    rows.select("row.*", F.col("prefix").alias(name)).repartition(F.col(f"`{name}`")).write.partitionBy(name).parquet(path)
    return name
