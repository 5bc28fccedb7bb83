"""Snapshots of several tables at once: a manifest names the stored version of each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has committed the version that this one wanted to."""


class Manifests:
    """Versions of a set of tables under a folder of any file system Spark reaches.

    Tables are written under fresh names first and are seen by nobody. A commit creates the file
    ``_manifests/<version>.json``, which names all of them, only if it isn't there yet: of two writers
    that started from one version one gets a Conflict, and ``update`` lets it try again
    from what the other has written. Readers see a version whole or not at all. The file system's
    creation of a new file has to be atomic, as that of HDFS is.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        fs, place = self._fs(f"{self.folder}/_manifests/*.json")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.globStatus(place) or [])

    def latest(self) -> int:
        """The last committed version; 0 where there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        """What a version holds: tables (name: path) and notes."""
        if not version:
            return {"tables": {}, "notes": {}}
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/_manifests/{version}.json")
        return json.loads(rows.first()[0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version or self.latest())["tables"][name])

    def stage(self, name: str, df: DataFrame, partitions: tuple[str, ...] = ()) -> str:
        """Write a table that the next commit can name."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partitions).parquet(path)
        return path

    def commit(self, base: int, tables: dict[str, str], notes: dict | None = None) -> int:
        """Make ``tables`` and, for the names not among them, the base version's the next version."""
        before = self.manifest(base)
        text = json.dumps({"tables": before["tables"] | tables, "notes": before["notes"] | (notes or {})}, ensure_ascii=False)
        fs, place = self._fs(f"{self.folder}/_manifests/{base + 1}.json")
        try:
            out = fs.create(place, False)
        except Py4JJavaError as e:
            if fs.exists(place):
                raise Conflict(f"version {base + 1} is there already") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return base + 1

    def update(self, change: Callable[[int], tuple[dict[str, DataFrame | str], dict]], tries: int = 5) -> int:
        """Commit what ``change`` makes of the latest version (its number; tables, or paths of staged ones, and notes), again from the start where another writer was faster."""
        for left in range(tries, 0, -1):
            base = self.latest()
            tables, notes = change(base)
            try:
                return self.commit(base, {name: x if isinstance(x, str) else self.stage(name, x) for name, x in tables.items()}, notes)
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError("unreachable")
