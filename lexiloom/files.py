"""Small files and folders of a table, by Hadoop's interface: whatever store Spark reads, this reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The folder's file system, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = lambda *parts: self.jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))
        self.system = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def read(self, *parts: str) -> str:
        stream = self.system.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, folder: str, name: str) -> None:
        """The file with all of its text, or an error if it's there already."""
        beside = self.path(folder, f".{name}.new")
        stream = self.system.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.system.exists(self.path(folder, name)) or not self.system.rename(beside, self.path(folder, name)):
            raise RuntimeError(f"{folder}/{name} was published by another writer")

    def delete(self, *parts: str) -> None:
        self.system.delete(self.path(*parts), True)

    def finished(self, folder: str) -> set[str]:
        """The names of the folder's subfolders that a Spark job has written to the end."""
        return {n for n in self.names(folder) if self.system.exists(self.path(folder, n, "_SUCCESS"))}
