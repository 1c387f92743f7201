"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

Words and character n-grams (byte windows, which may reach over the spaces
around a word and so know where it begins and ends) are hashed into one table
of vectors. A document is the mean of the vectors of all its features; a linear
layer and softmax follow. The model learns from a bounded sample of labelled
rows (``SAMPLE_ROWS``, chosen by hash of the id) that never holds a row of the
held-out fold.

Scoring is linear in the features, so each vector is first reduced to the one
number by which it moves the score; a text then costs a few table reads a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.quality_rules import held_out

SAMPLE_ROWS = 2_000
#: Longer documents are not trained on.
SAMPLE_TEXT_BYTES = 128 << 10
BITS = 16
#: Features of one kind have one part of the table: words, then n-grams by length.
GRAMS = (3, 4)
PARTS = 1 + len(GRAMS)
PREDICT_FROM = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: table rows of all features in text order, and the n + 1 offsets of the texts."""
    starts, ends, bounds = K.words(data, offsets, K.SPACED_WORD)
    yield (K.word_hashes(data, starts, ends) >> K.U64(64 - BITS)).astype(np.int64), bounds
    for kind, n in enumerate(GRAMS, 1):
        count = max(len(data) - n + 1, 0)
        code = np.zeros(count, np.uint32)
        for i in range(n):
            code = (code << np.uint32(8)) | data[i : i + count]
        at = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (kind << BITS)
        # Windows that cross into the next text are left out.
        lengths = np.maximum(np.diff(offsets) - n + 1, 0)
        text, place = K.spread(lengths)
        yield at[offsets[:-1][text] + place], np.r_[0, np.cumsum(lengths)]


@dataclass
class Model:
    """vectors (one row per feature), weights (dimension by class) and bias (by class)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def reduced(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log odds of class 1, and the constant."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimension: int = 8, epochs: int = 12, rate: float = 4.0, batch: int = 16, seed: int = 7) -> Model:
    """Stochastic gradient descent over (feature rows, counts) of each document; the rate falls linearly to 0."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / dimension, 1 / dimension, (PARTS << BITS, dimension)).astype(np.float32), np.zeros((dimension, 2), np.float32), np.zeros(2, np.float32))
    kept = [i for i, (at, _) in enumerate(docs) if len(at)]
    steps, done = epochs * -(-len(kept) // batch), 0
    for _ in range(epochs):
        rng.shuffle(kept)
        for x in range(0, len(kept), batch):
            own = kept[x : x + batch]
            at = np.concatenate([docs[i][0] for i in own])
            sizes = np.array([len(docs[i][0]) for i in own])
            share = np.concatenate([docs[i][1] / docs[i][1].sum() for i in own]).astype(np.float32)
            mean = np.add.reduceat(model.vectors[at] * share[:, None], np.cumsum(sizes) - sizes)
            logits = mean @ model.weights + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = p @ model.weights.T
            model.weights -= step / len(own) * (mean.T @ p)
            model.bias -= step / len(own) * p.sum(0)
            np.subtract.at(model.vectors, at, step * share[:, None] * np.repeat(back, sizes, 0))
            done += 1
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column("text"))
        for a in range(batch.num_rows):
            at = np.concatenate([rows for rows, _ in features(data[offsets[a] : offsets[a + 1]], np.array([0, offsets[a + 1] - offsets[a]]))])
            rows, counts = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, 1), pa.array([rows.astype("<u4").tobytes()]), pa.array([counts.astype("<u4").tobytes()])], names=["label", "rows", "counts"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on about ``sample_rows`` labelled documents outside the held-out fold, or on all if there are fewer.

    Documents of more than ``SAMPLE_TEXT_BYTES`` are not in the sample, so that
    what comes to the driver is bounded in bytes; they are scored like all others.
    """
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    share = min(1.0, sample_rows / max(1, label.count()))
    few = label.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample's ids and labels are bounded by sample_rows, so they may be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES).join(F.broadcast(few), "doc_id").select("label", "text")
    found = sorted((r["label"], bytes(r["rows"]), bytes(r["counts"])) for r in rows.mapInArrow(_featured, "label int, rows binary, counts binary").collect())
    return train([(np.frombuffer(r, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(np.float32)) for _, r, c in found], np.array([y for y, _, _ in found], np.int64))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, constant = shared.value
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets, 1 << 20):
                total, count = np.zeros(b - a), np.zeros(b - a, np.int64)
                for rows, bounds in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    sums = np.r_[0.0, np.cumsum(moves[rows], dtype=np.float64)]
                    total += sums[bounds[1:]] - sums[bounds[:-1]]
                    count += np.diff(bounds)
                score = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + constant)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score), pa.array((score >= PREDICT_FROM).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def digest(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document for the contract of operator 6.

    Null and empty texts have no features: their score is the bias alone.
    Repeated rows each get their row; a null id counts as not held out; without
    labels every score is 0.5. Columns besides doc_id, text and quality are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows).reduced())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, score double, predicted int")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
