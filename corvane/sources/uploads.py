"""Uploaded files: a type gate, and extraction that must succeed before a file is admitted.

Files are rows (path, content, …) of Spark's binary-file reader, in batch or as
a stream, so they may lie in any store. Each is opened in the task that reads
it; what is refused is one row of the quarantine with its reason, and nothing of
it is admitted. Spark's readers do not list files without a byte; as a row such
a file is refused as empty.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.packages import SUPPORTED
from corvane.sources.shared import new_folder

# The types that are taken; a file needs the type or the extension.
TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
MAIN_PART = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}
ADMITTED, UNSUPPORTED, EMPTY, NO_READER, BROKEN = "admitted", "unsupported type", "empty", "no reader", "extraction failed"


def _problem(kind: str, content: bytes) -> str:
    """Why a file cannot be extracted, or ``ADMITTED``."""
    if kind not in MAIN_PART:
        return NO_READER
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            root = ElementTree.fromstring(package.read(MAIN_PART[kind]))
            if package.testzip() is not None:
                return BROKEN
            return ADMITTED if len(root) else BROKEN
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError, NotImplementedError, RuntimeError):
        return BROKEN


def judged(files: DataFrame) -> DataFrame:
    """path, kind, length, outcome of every file (path, content and, where it is known, content_type).

    A supported content type or extension is enough, the type first; then an
    empty file, one of a kind without a reader, and one whose package, main
    part or checksums are broken are refused. A null content is empty.
    """
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    told = F.col("content_type") if "content_type" in files.columns else F.lit(None).cast("string")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.try_element_at(kinds, F.lower(told)), F.when(extension.isin(*SUPPORTED), extension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for name, content in zip(batch.column("kind").to_pylist(), batch.column("content")):
                raw = content.as_py() or b""
                sizes.append(len(raw))
                out.append(UNSUPPORTED if name is None else EMPTY if not raw else _problem(name, raw))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("kind"), pa.array(sizes, pa.int64()), pa.array(out, pa.string())], names=["path", "kind", "length", "outcome"])

    return files.select("path", kind.alias("kind"), "content").mapInArrow(run, "path string, kind string, length long, outcome string")


def admitted(files: DataFrame) -> DataFrame:
    """The files that pass, with all their columns."""
    return files.join(judged(files).where(F.col("outcome") == ADMITTED).select("path"), "path", "left_semi")


def quarantined(files: DataFrame) -> DataFrame:
    """path, kind, length and outcome of the files that are refused, one row each."""
    return judged(files).where(F.col("outcome") != ADMITTED)


def judged_stream(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 100) -> DataFrame:
    """What ``judged`` says of every file that is there, taken as a stream: each file once, also if a batch is replayed."""
    target, checkpoint = new_folder(spark, "uploads"), new_folder(spark, "uploads-checkpoint")
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)

    def write(batch: DataFrame, number: int) -> None:
        judged(batch).write.mode("overwrite").parquet(f"{target}/part={number}")  # a replay overwrites its own part

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, kind string, length long, outcome string, part int").parquet(target).drop("part")
