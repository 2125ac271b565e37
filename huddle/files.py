"""Small files and folders of a shared file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._new(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        p = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def size(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def claim(self, name: str) -> bool:
        """Makes an empty file; false if it was there. Of many callers one succeeds."""
        p = self._at(name)
        self._fs.mkdirs(p.getParent())
        try:
            return self._fs.createNewFile(p)
        except Exception as e:  # some file systems raise instead
            if "AlreadyExists" in str(e):
                return False
            raise

    def put(self, name: str, text: str) -> None:
        """A whole file at once: written aside, then renamed."""
        aside = self._at(f"{name}.{uuid.uuid4().hex[:8]}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if not self._fs.rename(aside, self._at(name)):
            raise OSError(f"cannot rename to {self.path}/{name}")

    def get(self, spark: SparkSession, name: str) -> str:
        return spark.read.option("wholetext", True).text(f"{self.path}/{name}").first()[0]

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)
