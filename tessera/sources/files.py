"""Small files in any store that Spark reaches: the driver's side of the catalog, by Hadoop's file systems."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """A folder by its path or address."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self.local = self._fs.getUri().getScheme() == "file"
        self._fs.mkdirs(self._path(self.root))

    def _at(self, name: str) -> object:
        return self._path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file as a whole; False if there is one of that name. Of several writers one succeeds."""
        if self.local:  # Hadoop's local file system looks and then writes; a link is made in one step
            folder = self._fs.makeQualified(self._path(self.root)).toUri().getPath()
            part = f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, f"{folder}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._at(name)):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name) if name else self._path(self.root), True)
