"""Several tables that change together: versions in a folder, the current one named by a pointer file.

A commit writes every changed table to a folder of its own, and then one
pointer file, renamed into place, that names the folders of all tables. Until
that rename readers see the version before, however many tables are written;
from it on they see all of them. A writer that dies in between leaves folders
that no pointer names, which ``vacuum`` deletes; the work done again from the
same version gives the same tables. The rename never replaces a pointer, so of
two writers from one version the second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"


class Conflict(RuntimeError):
    """Another commit has been made since the version that this one builds on."""


class Snapshots:
    """The versions of a set of tables under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    def version(self) -> int:
        """The number of the current version; -1 before the first commit."""
        where, files = self._path(POINTERS), self._files()
        if not files.exists(where):
            return -1
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def _pointer(self, version: int) -> dict[str, str]:
        if version < 0:
            return {}
        stream = self._files().open(self._path(f"{POINTERS}/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, by name; of the current one unless told."""
        pointer = self._pointer(self.version() if version is None else version)
        return {name: self.spark.read.parquet(f"{self.root}/{folder}") for name, folder in pointer.items()}

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Write the tables as the version after ``base``, whose other tables stay; returns its number."""
        pointer, files = self._pointer(base), self._files()
        for name, df in sorted(tables.items()):
            pointer[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(f"{self.root}/{pointer[name]}")
        draft, final = self._path(f"{POINTERS}/.{uuid.uuid4().hex}"), self._path(f"{POINTERS}/{base + 1:012d}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        never_replace = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, never_replace)
        except Exception as e:
            files.delete(draft, False)
            if files.exists(final):
                raise Conflict(f"version {base + 1} is there already") from e
            raise
        return base + 1

    def vacuum(self) -> list[str]:
        """Delete the folders that no pointer names, and return them; no commit may be under way."""
        files, named = self._files(), set()
        for version in range(self.version() + 1):
            named |= set(self._pointer(version).values())
        gone = []
        for table in files.listStatus(self._path("")):
            if table.isDirectory() and table.getPath().getName() != POINTERS:
                for folder in files.listStatus(table.getPath()):
                    name = f"{table.getPath().getName()}/{folder.getPath().getName()}"
                    if name not in named:
                        files.delete(folder.getPath(), True)
                        gone.append(name)
        return gone
