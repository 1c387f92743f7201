"""Token ids in Parquet: list columns with controlled encodings, row groups and page indexes.

Documents are range-partitioned by id and sorted within the partitions, so the
files in partition order hold all ids in ascending document order. Next to its
ids each row carries its place in the partition (``at``: tokens before it), so
a reader finds the tokens of a document from the metadata columns alone, and
Parquet's page index lets it read just those pages.

Text is encoded by the tokenizers library, one call for each distinct
space-separated piece: the tokenizer splits at white space first, so a text's
ids are its pieces' ids in turn. Texts with control characters that Python, but
not the tokenizer, takes for white space are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.sources.shared import new_folder

#: Distinct pieces, and distinct stems, that a Python worker remembers; it starts anew beyond that.
REMEMBERED_PIECES, REMEMBERED_STEMS = 600_000, 600_000
TEXT_CHUNK_BYTES = 4 << 20
ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
#: Python splits words at these, the tokenizer doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


#: Marks that the tokenizer parts from the letters before them; the apostrophe is not one, as it may start a suffix.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Below this code point every letter is its own normal form and has a one-letter lower case.
PLAIN_BELOW = "\u0130"
#: Byte-level vocabularies write printable bytes as themselves, and the others as characters from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = dict.fromkeys(_PRINTED) | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
BYTE_LEVEL = {b: b if c is None else c for b, c in BYTE_LEVEL.items()}


class PieceEncoder:
    """Ids of texts as bytes, by a tokenizers file whose pieces never span white space and are lower-cased.

    A piece of letters and trailing marks is its stem's ids and the marks' ids,
    so what the library encodes, once, are stems: a few hundred thousand of
    them for millions of different pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use all cores
        self.tokenizer, self.pieces, self.stems = Tokenizer.from_file(path), {}, {}
        self.tokenize = self.tokenizer.model.tokenize

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stem_ids(self, stem: str) -> bytes:
        """Lower-case plain letters are one word of the model, without the tokenizer's other steps."""
        word = stem if stem.isascii() else stem.encode().decode("latin-1").translate(BYTE_LEVEL)
        ids = [token.id for token in self.tokenize(word)]
        return pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: set[str]) -> None:
        if len(self.stems) > REMEMBERED_STEMS:
            self.stems = {}
        stems, pieces, other = self.stems, self.pieces, []
        for piece in new:
            if (ids := stems.get(piece)) is not None:  # a known stem as it is
                pieces[piece] = ids
                continue
            said = piece.lower()
            stem = said.rstrip(MARKS)
            # "<|" may begin a special token, whose case counts.
            if not stem.isalpha() or not (piece.isascii() or max(piece) < PLAIN_BELOW) or "<|" in piece:
                other.append(piece)
                continue
            ids = stems.get(stem)
            if ids is None:
                ids = stems[stem] = self._stem_ids(stem)
            if len(stem) < len(said):
                marks = said[len(stem) :]
                tail = stems.get(marks)
                if tail is None:
                    tail = stems[marks] = self._ids([marks])[0]
                ids = ids + tail
            pieces[piece] = ids
        for i in range(0, len(other), 10_000):
            pieces.update(zip(other[i : i + 10_000], self._ids(other[i : i + 10_000])))

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, then ``end``."""
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces = {}
        split = [None if any(c in t for c in ODD_SPACES) else t.split() for t in texts]
        new = set().union(*filter(None, split)).difference(self.pieces)
        if new:
            self._learn(new)
        ids_of = self.pieces.__getitem__
        return [(self._ids([t])[0] if s is None else b"".join(map(ids_of, s))) + end for t, s in zip(texts, split)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker."""
    return PieceEncoder(path)


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, at, doc_id, n_tokens and ids, ready to be written in ascending order of doc_id (nulls first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part, at = _encoder(path), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets, TEXT_CHUNK_BYTES):
                rows = batch.slice(a, b - a)
                ids = encoder.encode([t or "" for t in rows.column("text").to_pylist()], end)
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), rows.column("doc_id"), pa.array(lengths), lists], names=["part", "at", "doc_id", "n_tokens", "ids"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids array<int>")


def write(encoded: DataFrame, folder: str, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write token files; ``encoding`` of the ids is "dictionary" or "delta" (binary packed)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    options = {"compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.dictionary.page.size": 1 << 20, "parquet.page.write-checksum.enabled": "true"}
    if encoding == "delta":
        options |= {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
    encoded.write.options(**options).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids.

    Selecting only the first three reads only the metadata columns. The sum
    over parts has one row for each file, so its running total is small.
    """
    rows = spark.read.parquet(folder)
    bases = _bases(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def _bases(totals: DataFrame) -> DataFrame:
    """Tokens before each part: a running total over one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def checksums(tokens: DataFrame) -> DataFrame:
    """Replace ids by their count and crc32, as little-endian unsigned 32-bit integers."""
    names = [c for c in tokens.columns if c not in ("n_tokens", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = ids.offsets.to_pylist()
            sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=[*names, "n_tokens", "ids_crc32"])

    schema = ", ".join(f"{c} {t}" for c, t in tokens.select(names).dtypes)
    return tokens.mapInArrow(run, f"{schema}, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """One row per document for the contract of operator 9, all from the files read back.

    Null and empty texts hold the end id alone; repeated rows each get their
    row; null ids come first; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write(encode(docs, path, end_id), folder)
    rows = checksums(spark.read.parquet(folder).select("part", "at", "doc_id", "n_tokens", "ids"))
    totals = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return rows.join(_bases(totals), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

