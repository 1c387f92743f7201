"""Quality rules: gradient-boosted trees over document statistics.

The statistics of whole texts are taken in Arrow tasks. Trees are grown with
numpy on histograms of a bounded sample of labelled rows (``SAMPLE_ROWS``, by
hash order of the id) and flattened into node arrays, which score a batch level
by level. On chosen features the score may only fall as the feature rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.sources.shared import materialize

SAMPLE_ROWS = 20_000
KEEP_FROM = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature, and the direction that the score may take as it rises (0: any).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": 0, "digits": 0, "marks": 0, "wide": 0, "distinct": 0, "line_words": 0}

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?.,;:\"'()[]{}-_/\\@^~`+=", np.uint8))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]]) if len(s) else s
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text (rows of the batch), and the features made of them."""
    n = len(offsets) - 1
    rows = np.arange(n)

    def per_text(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return sums[at[1:]] - sums[at[:-1]]

    starts, ends, bounds = K.words(data, offsets, K.SPACED_WORD)
    hashes = K.word_hashes(data, starts, ends)
    n_words = np.diff(bounds)
    owner = np.repeat(rows, n_words)
    own = K.mix(owner.astype(K.U64) + K.U64(1))
    inside = K.SPACED_WORD[data] & ~_CONTINUES[data]
    word_chars = per_text(inside)

    grams = K.gram_hashes(hashes, 3)
    whole = owner[: len(grams)] == owner[2:] if len(grams) else np.zeros(0, bool)
    again = np.zeros(len(grams), bool)
    again[whole] = _repeated(K.mix(grams[whole] ^ own[: len(grams)][whole]))
    in_repeat = np.zeros(len(hashes), bool)
    for i in range(3):
        in_repeat[i : i + len(again)] |= again

    # Lines are runs between line feeds and text ends; those with a word count.
    feeds = np.flatnonzero(data == 10)
    first = np.unique(np.r_[offsets[:-1], feeds + 1])
    first = first[first < len(data)]
    last = np.r_[first[1:], len(data)]
    last = last - ((last > first) & (data[last - 1] == 10)) if len(first) else last
    lines_of = np.searchsorted(offsets, first, "right") - 1
    said = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, lines_of = first[said], last[said], lines_of[said]
    line_key = K.mix(K.word_hashes(data, first, last) ^ K.mix(lines_of.astype(K.U64) + K.U64(1)))
    _, seen = np.unique(line_key, return_index=True)
    n_lines = np.bincount(lines_of, minlength=n)
    n_dup_lines = n_lines - np.bincount(lines_of[seen], minlength=n)
    _, seen = np.unique(K.mix(hashes ^ own), return_index=True)
    distinct = np.bincount(owner[seen], minlength=n)

    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_text(_SYMBOL[data]), "n_dup_lines": n_dup_lines, "n_repeat_words": per_text(in_repeat, bounds)}
    chars, some = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    out |= {
        "log_words": np.log1p(n_words), "word_length": word_chars / some, "symbols": out["n_symbols"] / chars, "dup_lines": n_dup_lines / np.maximum(n_lines, 1), "repeats": out["n_repeat_words"] / some,
        "upper": per_text(_UPPER[data]) / chars, "digits": per_text(_DIGIT[data]) / chars, "marks": per_text(_MARK[data]) / chars, "wide": per_text(data >= 0xC0) / chars, "distinct": distinct / some, "line_words": n_words / np.maximum(n_lines, 1),
    }
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Too short, or more than half of the words in repeated three-word windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass
class Trees:
    """Flattened trees: node i goes left if feature[i] <= threshold[i]; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.bias)
        every = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[every, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss, by histograms; each monotone split bounds the values below it."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        for column, start in ((feature, 0), (threshold, np.inf), (left, i), (right, i), (value, 0.0)):
            column.append(start)
        return i

    raw = np.full(len(y), bias)
    for _ in range(n_trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        gradient, curve = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            i, rows, low, high, level = todo.pop()
            g, h = gradient[rows].sum(), curve[rows].sum()
            value[i] = rate * float(np.clip(g / (h + ridge), low, high))
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(x.shape[1]) if level < depth else ():
                of = binned[j][rows]
                gl, hl = (np.cumsum(np.bincount(of, w[rows], len(cuts[j]) + 1))[:-1] for w in (gradient, curve))
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + (g - gl) * vr - 0.5 * (h - hl + ridge) * vr**2 - 0.5 * g * g / (h + ridge)
                gain[(hl < least) | (h - hl < least) | (directions[j] * (vr - vl) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            if best[1] >= 0:
                _, j, k, vl, vr = best
                feature[i], threshold[i], left[i], right[i] = j, float(cuts[j][k]), node(), node()
                go = binned[j][rows] <= k
                middle = (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[j]]
                todo += [(left[i], rows[go], *bounds[0], level + 1), (right[i], rows[~go], *bounds[1], level + 1)]
            else:
                raw[rows] += value[i]
    arrays = [np.array(c) for c in (roots, feature, threshold, left, right, value)]
    return Trees(*(a.astype(np.int64) if k in (0, 1, 3, 4) else a for k, a in enumerate(arrays)), depth=depth, bias=bias)


def _features(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([stats[name] for name in FEATURES]).astype(np.float64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column("text"))
        for a, b in K.chunks(offsets):
            stats = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(v) for v in stats.values())], names=["doc_id", *stats])


_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the features of every text (null: no words)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.trimmed(_measured), _STATS)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(doc_id.cast("long").cast("string")) % 4 == 2


def sampled(labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id and quality of about ``sample_rows`` labelled documents outside the held-out fold, or all if there are fewer."""
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    share = min(1.0, sample_rows / max(1, label.count()))
    return label.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from labels.quality of the measured documents among the sampled ones."""
    sample = measured.join(sampled(labels, sample_rows), "doc_id").select("quality", *FEATURES).toPandas().sort_values(["quality", *FEATURES])
    return grow(sample[list(FEATURES)].to_numpy(np.float64), sample["quality"].to_numpy(np.float64), list(FEATURES.values()))


def _judged(shared, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            stats = {name: batch.column(name).to_numpy() for name in (*BASE, *FEATURES)}
            failed = base_failed(stats)
            score = trees.score(_features(stats))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_FROM))], names=[*carried, "base_failed", "score", "kept"])

    return run


def digest(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document for the contract of operator 2.

    Null and empty texts have no words and fail the base rule; repeated rows
    each get their row; without labels the trees say 0.5 and keep what passes
    the base rule. Columns besides doc_id, text and quality are not read.
    """
    measured = materialize(measure(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, sample_rows))
    carried = ["doc_id", *BASE]
    return measured.mapInArrow(_judged(shared, carried), "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, with all their columns, that pass the base rule and the trees."""
    # Only the sample is measured apart; all others are measured where they are judged. Its ids are as bounded as it is.
    few = F.broadcast(sampled(labels, sample_rows).select("doc_id"))
    sample = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(few, "doc_id", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(fit(measure(sample), labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets):
                stats = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array(~base_failed(stats) & (trees.score(_features(stats)) >= KEEP_FROM)))

    return docs.mapInArrow(K.trimmed(run), docs.schema)
