"""Small files beside tables (manifests), by Hadoop's file systems, so that they work wherever Spark writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder as the driver sees it through Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a subfolder, sorted; none if it isn't there."""
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str):
        """A JSON file's content."""
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, content) -> bool:
        """Writes a JSON file that must not be there yet; says whether it did. The file appears whole: it is written aside and renamed."""
        aside, at = self._path(f"_aside-{uuid.uuid4().hex}"), self._path(name)
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.hsync()
        stream.close()
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
