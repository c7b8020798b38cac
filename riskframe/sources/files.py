"""Small files and folders, in whatever file system Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Small files and folders in the file system of a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.root = path.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def times(self, folder: str) -> dict[str, int]:
        """Modification time of each file of a folder."""
        at = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def put_new(self, name: str, text: str) -> bool:
        """Make a file in one step; false if there is one of that name, which stays as it is."""
        folder, _, leaf = name.rpartition("/")
        self.fs.mkdirs(self.path(folder))
        passing = self.path(f"{folder}/.{leaf}.{uuid.uuid4().hex}")
        out = self.fs.create(passing, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.exists(self.path(name)) and self.fs.rename(passing, self.path(name)):
            return True
        self.fs.delete(passing, False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
