"""Versions of a map that a stream keeps up to date: a log of committed versions beside their data."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from sensorweave.operators.codebook import Codebook
from sensorweave.sources.models import read_codebook, write_codebook


class MapVersions:
    """Committed maps below ``path``: data in ``version=<n>-<id>``, one entry per commit in ``_log``.

    An entry appears by a rename, after its data is whole; a reader sees the last committed map or an earlier one,
    never a half-written one. All through the file system that Spark uses for ``path``. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        sc = spark.sparkContext
        self._Path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(sc._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._Path("/".join([self.path, *parts]))

    def _entries(self) -> dict[int, str]:
        """Version to folder name, of the committed ones. An entry's name holds both."""
        log = self._at("_log")
        if not self._fs.exists(log):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return {int(n.split("~")[0]): n.split("~")[1] for n in names if "~" in n and not n.startswith(".")}

    def versions(self) -> list[int]:
        return sorted(self._entries())

    def last(self) -> int | None:
        return max(self._entries(), default=None)

    def read(self, version: int | None = None) -> Codebook:
        """The map of ``version``, or of the last one committed."""
        entries = self._entries()
        if version is None:
            version = max(entries, default=None)
        if version not in entries:
            raise ValueError(f"no committed version {version} below {self.path}")
        return read_codebook(self.spark, f"{self.path}/{entries[version]}")

    def commit(self, version: int, book: Codebook) -> bool:
        """Write and commit a version; false, and nothing is written, if it is committed already."""
        if version in self._entries():
            return False
        folder = f"version={version}-{uuid.uuid4().hex}"
        write_codebook(book.table(self.spark), f"{self.path}/{folder}")
        self._fs.mkdirs(self._at("_log"))
        draft = self._at("_log", f".{uuid.uuid4().hex}")
        self._fs.create(draft, False).close()
        if not self._fs.rename(draft, self._at("_log", f"{version}~{folder}")):
            raise OSError(f"version {version} below {self.path} was not committed")
        return True

    def compact(self, keep: int) -> None:
        """Remove all but the last ``keep`` versions, and data that was never committed."""
        if keep < 1:
            raise ValueError("at least one version stays")
        entries = self._entries()
        for v in sorted(entries)[:-keep]:
            self._fs.delete(self._at("_log", f"{v}~{entries[v]}"), False)  # the entry first: no reader finds it half gone
            del entries[v]
        for s in self._fs.listStatus(self._at()):
            name = s.getPath().getName()
            if name.startswith("version=") and name not in entries.values():
                self._fs.delete(s.getPath(), True)
