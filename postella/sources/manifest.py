"""Snapshots of a saved index: which parts it has, each one small file that is renamed into place.

A snapshot names whole parts, and a part is written before the snapshot that names it, so whoever reads the latest one sees
an index as it was before or after a change, never in between. The rename fails where the file exists: of two writers that go
on from one snapshot one is refused, and looks again.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """The snapshots under a path, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._jvm, self._gateway = jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path, self.folder = path, jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        self._fs = self.folder.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def versions(self) -> list[int]:
        if not self._fs.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self.folder)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{10})\.json", n)))

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A snapshot and its number, the latest unless one is asked for; (0, {}) where there is none."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        elif version not in have:
            raise ValueError(f"{self.path} has no snapshot {version}")
        if not version:
            return 0, {}
        at = self._at(f"{version:010d}.json")
        with_length = self._fs.open(at)
        try:
            return version, json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(with_length)))
        finally:
            with_length.close()

    def commit(self, version: int, snapshot: dict) -> bool:
        """Make this the snapshot of that number; False if there is one already."""
        aside = self._at(f".{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._at(f"{version:010d}.json")), options)
        except Exception:
            self._fs.delete(aside, False)
            if version in self.versions():
                return False
            raise
        return True

    def drop(self, versions: list[int]) -> None:
        for v in versions:
            self._fs.delete(self._at(f"{v:010d}.json"), False)

    def drop_part(self, part: str, tables: list[str]) -> None:
        for t in tables:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{t}/part={part}"), True)
