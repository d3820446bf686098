"""Shared scratch folders and files through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names. Only a local session may lack that."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quire-")
    return f"{where.rstrip('/')}/quire-{uuid.uuid4().hex}"


class Files:
    """Small files and folders under one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none if there is no such folder."""
        if not self.fs.exists(self.at(name)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, temporary: str, name: str, over: bool = False) -> None:
        """Renames a whole file to the name that readers look for: an error if it is taken, unless over is set."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(name).toUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if over else kind.NONE
        context.rename(self.at(temporary), self.at(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
