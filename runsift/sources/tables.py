"""Tables and small files in a folder that the driver and the executors share, by Spark's writers and Hadoop's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has no more rows than this.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named and all runs in one process, one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"file://{tempfile.mkdtemp(prefix='streams-')}"


def written(df: DataFrame) -> DataFrame:
    """df written to and read again from the shared folder: computed once, and the same whatever task is run again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if it has no more than so many rows; a larger one is joined by shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Folder:
    """A folder of small files on any store that Spark knows; a file is there whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if self.exists() else []

    def put(self, name: str, text: str, replace: bool = True) -> bool:
        """Writes a file beside its place and moves it there; False if it is there already and not to be replaced."""
        beside = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside, True)
        out.write(text.encode())
        out.close()
        if replace and self.exists(name):
            self._fs.delete(self._path(name), False)
        moved = not self.exists(name) and self._fs.rename(beside, self._path(name))
        if not moved:
            self._fs.delete(beside, False)
        return moved

    def get(self, name: str) -> str | None:
        """The text of a file; null if it is not there."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
