"""Small files through Hadoop's file system API, so that a store may lie wherever Spark can write.

A commit's name is taken by a rename that must not replace a file. HDFS and local folders refuse that
in one step; on an object store, where a rename is a copy, give a store one writer.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may do without, in a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or tempfile.mkdtemp(prefix="lumispan-")).rstrip("/")


class Folder:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish_json(self, name: str, value: dict) -> bool:
        """Write a whole file under a name that must be new; False if another writer took it."""
        at, temp = self._at(name), self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(temp, at):
            self._fs.delete(temp, False)
            return False
        return True
