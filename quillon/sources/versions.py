"""Versions of a table in a folder: written aside, published by one rename.

``base/_versions/<number>`` is a small file that says what the version consists
of; the highest number is the table's state.  Data lie in folders of their
own, so a reader sees the state before or after a write whenever the
writer dies, and a plan that reads an older version goes on.  Of two writers that
started from the same version the second one's rename fails (Conflict).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published this number."""


class Store:
    """The published versions of a folder, newest last."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.base}/{name}" if name else self.base)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(n) for n in self._names("_versions") if n.isdigit()]

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """A version (the newest) and what it says; 0 and nothing if there is none."""
        have = self.numbers()
        if number is None and not have:
            return 0, {}
        number = have[-1] if number is None else number
        stream = self.fs.open(self._path(f"_versions/{number:012d}"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, after: int, content: dict) -> int:
        """Makes content the version that follows ``after``."""
        aside = self._path(f"_aside/{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self.fs.mkdirs(self._path("_versions"))
        jvm = self.spark._jvm
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path(f"_versions/{after + 1:012d}"), plain)
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} of {self.base} exists") from None
            raise
        return after + 1

    def folder(self, after: int, prefix: str = "data") -> str:
        """The path of a new folder for rows of the version that follows ``after``."""
        return f"{self.base}/{prefix}-{after}-{uuid.uuid4().hex}"

    def expire(self, keep: int = 2) -> None:
        """Drops all versions but the last ``keep``, and folders that these don't name, but those of writers at work.

        A folder whose version's number has been taken is either named by that
        version or its writer's, who gets a Conflict; one for the next number may still be published.
        """
        have = self.numbers()
        used = json.dumps([self.read(n)[1] for n in have[-keep:]])
        for n in have[:-keep]:
            self.fs.delete(self._path(f"_versions/{n:012d}"), False)
        for name in self._names(""):
            if name not in used and name.count("-") == 2 and int(name.split("-")[1]) < have[-1]:
                self.fs.delete(self._path(name), True)


def read_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version (the newest); None if nothing was published."""
    _, content = Store(spark, base).read(number)
    if not content:
        return None
    schema = content["schema"]
    return spark.read.format(content["format"]).schema(schema).load(content["folder"])


def write_version(df: DataFrame, base: str, kind: str = "parquet", after: int | None = None, keep: int = 2) -> DataFrame:
    """df as the next version of the table, after the one it was made from (``after``; by default the newest)."""
    store = Store(df.sparkSession, base)
    after = store.read()[0] if after is None else after
    folder = store.folder(after)
    df.write.format(kind).save(folder)
    store.publish(after, {"folder": folder, "format": kind, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)})
    store.expire(keep)
    return read_version(df.sparkSession, base)
