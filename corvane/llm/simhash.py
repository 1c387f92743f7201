"""Document fingerprints: SimHash, and a search by permuted block tables.

A document's terms are its words and its shingles of five words (all words, if
there are fewer), lower-cased in ASCII. A term weighs by how often the text
holds it, 1, 2, 3 … for 1, 2 to 3, 4 to 7 … times, shingles twice as much. Every
term hash casts its weight on each of ``BITS`` bits, for where the bit is set,
against where it is not; the signs are the fingerprint. Its bits differ from
another's in proportion to the angle between the weighted terms.

Search: fingerprints within ``radius`` bits of each other agree in at least one
of radius + 1 blocks of bits, permuted so that a block takes bits from all over
the fingerprint. Each block is a table; a query meets what agrees with it there,
and a pair counts at the first block in which it agrees.

Defined results: a null or empty text, or one without words, has no votes and
so all bits clear; equal texts have equal fingerprints, whatever their ids;
rows that share an id, or are equal, are documents of their own; null ids come
last in descending order; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.sources.shared import materialize

BITS, SHINGLE = 256, 5
#: Whole texts that pass between Spark and a worker at once.
BATCH_ROWS = 500
LANES = BITS // 4
#: Terms that are summed before 16-bit lanes could overflow: weights are at most 2 * 32.
RUN = 1000
_SALTS = [K.U64((i + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) for i in range(BITS // 64)]


def _half_bytes() -> np.ndarray:
    """For each half byte, its four bits in four 16-bit lanes."""
    bits = (np.arange(16)[:, None] >> np.arange(4)) & 1
    return (bits.astype(K.U64) << (K.U64(16) * np.arange(4, dtype=K.U64))).sum(axis=1, dtype=K.U64)


_LANES = _half_bytes()


def _votes(terms: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Twice the weight of each document's terms that set a bit, less the weight of all: n rows of ``BITS``."""
    out = np.zeros((n, BITS), np.int64)
    if not len(terms):
        return out
    # Runs of one document's terms, short enough for the lanes.
    place = np.arange(len(of)) - np.searchsorted(of, of)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]] | (place % RUN == 0))
    for at in range(0, len(first), 4096):
        begin, end = first[at], first[at + 4096] if at + 4096 < len(first) else len(terms)
        own, w = terms[begin:end], weights[begin:end].astype(K.U64)
        sums = np.zeros((len(first[at : at + 4096]), LANES), K.U64)
        for i, salt in enumerate(_SALTS):
            hashes = K.mix(own + salt)
            for j in range(16):
                lanes = _LANES[((hashes >> K.U64(4 * j)) & K.U64(15)).astype(np.intp)] * w
                sums[:, 16 * i + j] = np.add.reduceat(lanes, first[at : at + 4096] - begin)
        wide = np.ascontiguousarray(sums).view(np.uint16).reshape(len(sums), BITS)
        np.add.at(out, of[first[at : at + 4096]], wide.astype(np.int64))
    return 2 * out - np.bincount(of, weights=weights, minlength=n).astype(np.int64)[:, None]


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``BITS`` / 8 bytes for each of the texts end to end."""
    n = len(offsets) - 1
    raw = K.LOWER[data]
    starts, ends, bounds = K.words(raw, offsets, K.SPACED_WORD)
    words = K.word_hashes(raw, starts, ends)
    counts = np.diff(bounds)
    of = np.repeat(np.arange(n), counts)
    grams = K.gram_hashes(words, SHINGLE)
    whole = np.flatnonzero(of[: len(grams)] == of[SHINGLE - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.intp)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    shorter = [K.mix(K.gram_hashes(words[bounds[i] : bounds[i + 1]], int(counts[i])) + K.U64(counts[i])) for i in short.tolist()]
    terms = np.concatenate([words, K.mix(grams[whole] ^ K.U64(SHINGLE)), *shorter])
    owner = np.concatenate([of, of[whole], short])
    kind = np.repeat([1, 2], [len(words), len(terms) - len(words)])
    order = np.lexsort((terms, owner))
    terms, owner, kind = terms[order], owner[order], kind[order]
    first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])]) if len(terms) else order
    tf = np.diff(np.append(first, len(terms)))
    weights = kind[first] * (1 + np.log2(np.maximum(tf, 1)).astype(np.int64))
    votes = _votes(terms[first], weights, owner[first], n)
    return np.packbits(votes > 0, axis=1, bitorder="little")


def _texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column("text"))
        for a, b in K.chunks(offsets):
            made = fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([x.tobytes().hex() for x in made], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex digits) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_print, "doc_id long, fingerprint string")


def _numbers(fingerprint: Column) -> list[Column]:
    """The fingerprint as 64-bit numbers."""
    part = lambda i: F.conv(F.substring(fingerprint, 16 * i + 1, 16), 16, -10).cast("long")
    return [part(i) for i in range(BITS // 64)]


def distance(a: Column, b: Column) -> Column:
    """In how many bits two fingerprints differ."""
    x, y = _numbers(a), _numbers(b)
    total = F.bit_count(x[0].bitwiseXOR(y[0]))
    for i in range(1, len(x)):
        total = total + F.bit_count(x[i].bitwiseXOR(y[i]))
    return total


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the differing bits of two fingerprints stand for, 0 where it is negative; equal ones have 1."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(np.pi) * distance(a, b) / BITS))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """An array of the fingerprint's radius + 1 blocks; block i takes the hex digits i, i + radius + 1, …"""
    digits = BITS // 4
    return F.array(*[F.concat(*[F.substring(fingerprint, d + 1, 1) for d in range(i, digits, radius + 1)]) for i in range(radius + 1)])


def within(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(query, found, differ): every fingerprint of ``prints`` within ``radius`` bits of a fingerprint of ``queries``, itself included.

    Both have a column ``fingerprint``; equal ones count once, so copies are
    not expanded. ``radius`` is at most 63, as a block holds a hex digit at
    least. Null fingerprints match nothing.
    """
    if not 0 <= radius < BITS // 4:
        raise ValueError(f"radius must be from 0 to {BITS // 4 - 1}")

    def told(df: DataFrame, name: str) -> DataFrame:
        own = df.where("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct()
        return own.select(name, _blocks(F.col(name), radius).alias(f"{name}_blocks")).select("*", F.posexplode(f"{name}_blocks").alias("table", "block"))

    pairs = told(queries, "query").join(told(prints, "found"), ["table", "block"])
    agree = F.transform(F.arrays_zip("query_blocks", "found_blocks"), lambda b: b["query_blocks"] == b["found_blocks"])
    first = F.array_position(agree, F.lit(True)) - 1 == F.col("table")
    return pairs.where(first).select("query", "found", distance(F.col("query"), F.col("found")).alias("differ")).where(F.col("differ") <= radius)


_DONE = "part int, edge int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"
INNER, HEAD, TAIL = range(3)
_ROW = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "text"))])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many leading characters of the following one, or all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(part: int, rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows of all but the last of (doc_id, text, fingerprint)."""
    changed = [edited(a[1], b[1]).encode() for a, b in zip(rows, rows[1:])]
    prints = [x.tobytes().hex() for x in fingerprints_of(*_texts(changed))]
    made = [
        (part, INNER, a[0], len(a[1]), hashlib.sha256(c).hexdigest(), a[2], p, b[2], None)
        for a, b, c, p in zip(rows, rows[1:], changed, prints)
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [()] * len(_ROW), _ROW)], schema=_ROW)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in descending order: each with its next; the first and the last also with their texts."""
    part, before, last = 0, [], None
    for batch in batches:
        ids, parts = batch.column("doc_id").to_pylist(), batch.column("part")
        data, offsets = K.utf8(batch.column("text"))
        for a, b in K.chunks(offsets):
            own = fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw = data[offsets[a] : offsets[b]].tobytes()
            texts = [raw[x:y].decode() for x, y in zip((offsets[a:b] - offsets[a]).tolist(), (offsets[a + 1 : b + 1] - offsets[a]).tolist())]
            rows = [*before, *zip(ids[a:b], texts, (x.tobytes().hex() for x in own))]
            part = parts[a].as_py()
            if last is None:
                yield _edge(part, HEAD, rows[0])
            if len(rows) > 1:
                yield _pairs(part, rows)
            before = [last := rows[-1]]
    if last is not None:
        yield _edge(part, TAIL, last)


def _edge(part: int, kind: int, row: tuple[int | None, str, str]) -> pa.RecordBatch:
    made = (part, kind, row[0], len(row[1]), None, row[2], None, None, row[1])
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, _ROW)], schema=_ROW)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of a range with the first one of the next."""
    for batch in batches:
        for r in batch.to_pylist():
            yield _pairs(r["part"], [(r["doc_id"], r["text"], r["fingerprint"]), (None, r["next_text"], r["next_print"])])


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is planned and run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document for the contract of operator 13.

    Texts are dealt out once, in ranges of descending ids. Only the first and
    the last document of a range meet others across its bounds: two rows for
    each range, however many documents there are.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.desc("tie"), F.desc("text")]
    ranges = texts.repartitionByRange(partitions, *order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    with batches_of(docs.sparkSession, BATCH_ROWS):
        done = materialize(ranges.select("doc_id", "text", "part").mapInArrow(_along, _DONE), "fingerprints")

    heads = done.where(F.col("edge") == HEAD).select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = done.where(F.col("edge") == TAIL).select("part", "doc_id", "text", "fingerprint")
    # Ranges without rows leave gaps in the numbers; one small row for each range, in one place.
    numbers = [r["part"] for r in heads.select("part").orderBy("part").collect()]
    follows = docs.sparkSession.createDataFrame(list(zip(numbers, [*numbers[1:], *numbers[:1]])), "part int, next_part int")
    met = tails.join(follows, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part").select("part", "doc_id", "text", "fingerprint", "next_text", "next_print")
    rows = done.where(F.col("edge") == INNER).unionByName(met.mapInArrow(_meet, _DONE))
    like = lambda c: likeness(F.col("fingerprint"), F.col(c))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
