"""Intermediate tables of operators that work in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the session's own checkpoint folder; a new temporary one in local mode, and an error on a cluster without any."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marlstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Rounds:
    """Tables of a loop, written to the shared folder: each name holds the last one stored under it, and what is two rounds old is deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[str, list[str]] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{name}-{self.n}"
        df.write.parquet(path)
        old = self.paths.setdefault(name, [])
        old.append(path)
        while len(old) > 2:
            self._delete(old.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
