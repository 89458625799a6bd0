"""Folders that the cluster shares: results written once, and tables kept there in versions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the cluster shares; a temporary one in local mode only."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) if found.isEmpty() else found.get()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp()}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once as Parquet: cuts the lineage, and survives the loss of executors. A write that was broken off is done again."""
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few calls on a shared file system that the driver needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm, self.folder = spark._jvm, folder

    def names(self, pattern: str) -> list[str]:
        """Paths below the folder that fit a glob, relative to it."""
        root = self.fs.makeQualified(self.path(self.folder)).toUri().getPath().rstrip("/") + "/"
        return sorted(x.getPath().toUri().getPath().removeprefix(root) for x in self.fs.globStatus(self.path(f"{self.folder}/{pattern}")) or ())

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.folder}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file, whole or not at all: written beside its place, then renamed."""
        stream = self.fs.create(self.path(f"{self.folder}/{name}.tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self.path(f"{self.folder}/{name}"), False)
        if not self.fs.rename(self.path(f"{self.folder}/{name}.tmp"), self.path(f"{self.folder}/{name}")):
            raise OSError(f"{name} can't be put in place")
