"""A stored table with versions: plans are applied by writing the whole next version and then naming it.

The rows of a version lie in a folder of their own. What makes it the table's is a small file with its number, created only if
there is none: of two writers that began from the same version one succeeds, and the other is refused. Readers look for the
last number whose file is whole and so see a version in whole or not at all; a write that died before that is never seen.
Should it have died within that file, the number stays taken until the file is removed.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .work import write_settings


class Conflict(Exception):
    """The table has another version than the one that a plan was made from."""


class VersionedTable:
    """The table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _named(self) -> dict[int, str]:
        """The numbers that were given, and the files that say so."""
        fs, folder = self._file("_versions")
        if not fs.exists(folder):
            return {}
        return {int(f.getPath().getName()): f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().isdigit()}

    def version(self) -> int:
        """The last version's number, 0 where nothing was committed yet."""
        return max((n for n, path in self._named().items() if self._said(path)), default=0)

    def _said(self, path: str) -> dict | None:
        """What a version's file says; None while it is being written."""
        text = "".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())  # one small file
        return json.loads(text) if text.endswith("}") else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last."""
        number, named = self.version() if version is None else version, self._named()
        said = self._said(named[number]) if number in named else None
        if said is None:
            raise ValueError(f"{self.path} has no version {number}")
        return self.spark.read.schema(said["schema"]).parquet(f"{self.path}/{said['folder']}")

    def commit(self, rows: DataFrame, base: int) -> int:
        """Writes rows as the version after base and returns its number; Conflict if that number has been given to another."""
        if (now := max(self._named(), default=0)) != base:
            raise Conflict(f"version {now} instead of {base}")
        folder = f"rows-{uuid.uuid4().hex}"
        with write_settings(self.spark):
            rows.write.parquet(f"{self.path}/{folder}")
        fs, name = self._file(f"_versions/{base + 1:012d}")
        body = json.dumps({"folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)}).encode()
        try:
            out = fs.create(name, False)  # an error where there is such a file
        except Py4JJavaError as e:
            if not fs.exists(name):
                raise
            stale_fs, stale = self._file(folder)
            stale_fs.delete(stale, True)
            raise Conflict(f"version {base + 1} was written by another") from e
        out.write(body)
        out.close()
        return base + 1
