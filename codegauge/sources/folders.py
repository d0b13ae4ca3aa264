"""Small files and folders through Hadoop's file system, wherever a path lies."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder and what stands in it; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._make(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit_text(self, name: str, text: str) -> None:
        """Writes beside the place and renames, so the file is there whole or not at all; an existing one stays."""
        part = self._at(f"{name}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(part, self._at(name)) and not self.exists(name):
            raise OSError(f"{self.path}/{name} could not be committed")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
