"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, which only a local session may leave it, a new temporary folder."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("corvane.shared.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("corvane.shared.dir", folder)
    return folder.rstrip("/")


#: Paths that this process has handed out, for clear().
_handed_out: list[str] = []


#: Those handed out inside the innermost scratch() of this thread.
_own: ContextVar[list[str] | None] = ContextVar("corvane_own_folders", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    if (own := _own.get()) is not None:
        own.append(path)
    return path


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths that are handed out inside, in order, to whatever runs in this thread; other queries' are not among them."""
    own: list[str] = []
    token = _own.set(own)
    try:
        yield own
    finally:
        _own.reset(token)


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it has run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that nothing reads any more."""
    _delete(spark, paths)
    for path in paths:
        if path in _handed_out:
            _handed_out.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; call it once all results have been read."""
    _delete(spark, _handed_out)
    _handed_out.clear()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
