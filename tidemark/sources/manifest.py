"""Atomic commits for tables kept as immutable Parquet folders.

A table is a folder with ``data/`` (each write goes to a folder of its own) and numbered manifests.
A manifest names the folders that make up one version, so it is the only thing that has to appear
atomically: it is written under a temporary name and renamed to ``manifest-<n>.json``. A job that
dies before the rename leaves unreferenced folders and no trace in the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer committed the same version first."""


class Manifest:
    """The versions of one table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs.mkdirs(self._path(f"{self.path}/data"))

    def _numbers(self) -> list[int]:
        found = []
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("manifest-") and name.endswith(".json"):
                found.append(int(name[9:-5]))
        return sorted(found)

    def current(self) -> tuple[int, dict]:
        """Number and content of the newest version; ``(0, {})`` for a table without commits."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{numbers[-1]:08d}.json"))
        try:
            return numbers[-1], json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def new_data(self) -> str:
        """A folder for one write."""
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def commit(self, base: int, content: dict) -> int:
        """Make ``content`` the version after ``base``; fails if that version exists already."""
        final = self._path(f"{self.path}/manifest-{base + 1:08d}.json")
        temporary = self._path(f"{self.path}/.tmp-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise ConflictError(f"version {base + 1} of {self.path} exists")
        return base + 1

    def subfolders(self, folder: str) -> list[str]:
        """Names of the partition folders of one write."""
        p = self._path(folder)
        if not self._fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName())
