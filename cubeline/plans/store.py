"""Files of the folder that the whole cluster shares, and small facts that stand there by number."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Store:
    """Paths are under `root`.  A fact is a small JSON value; the last one put stands.

    A fact's versions are numbered files.  Each is written aside and then named, so a reader
    sees the one before or the new one, whatever breaks off in between.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _of(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._of(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._of(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """What a folder holds, sorted; nothing if there is none."""
        p, fs = self._of(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self, name: str) -> list[int]:
        return sorted(int(n) for n in self.names(f"{self.root}/_facts/{name}") if n.isdigit())

    def get(self, name: str, default=None):
        have = self._versions(name)
        if not have:
            return default
        p, fs = self._of(f"{self.root}/_facts/{name}/{have[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, value) -> None:
        have = self._versions(name)
        folder = f"{self.root}/_facts/{name}"
        new = (have[-1] if have else 0) + 1
        aside, fs = self._of(f"{folder}/.{new}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not fs.rename(aside, self._of(f"{folder}/{new}")[0]):
            raise RuntimeError(f"fact {name} was put by another writer meanwhile")
        for old in have[:-1]:  # the one before stays for readers that have just listed it
            self.delete(f"{folder}/{old}")
