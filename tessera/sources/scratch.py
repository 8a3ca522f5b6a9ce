"""Scratch tables in the folder that all executors share, and small records in a file system that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Without that setting, a temporary one serves a single machine; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written and read again: what numbers its partitions stays as it is, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows that one task is dealt
TASK_ROWS = 1 << 18


def tasks_for(rows: DataFrame, most: int = TASK_ROWS) -> int:
    """How many tasks to deal ``rows`` to, so that none gets many more than ``most``: it grows with the rows, and so a task's memory does not."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


class Records:
    """Small text files of one folder, by Hadoop's file system: each is written once, whole, and only where there is none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str | None = None):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder if name is None else f"{self.folder}/{name}")

    def names(self) -> list[str]:
        if not self.fs.exists(self._path()):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path()) if not f.getPath().getName().startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the name is taken."""
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
