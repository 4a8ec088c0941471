"""Small files and listings through Hadoop's file systems, so a store may lie wherever Spark reads: local, HDFS or object stores."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return bool(fs.exists(where))

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def write(self, path: str, text: str) -> None:
        """Write a file of a new name: under a temporary one first, so that no reader sees a part of it."""
        fs, where = self._at(path)
        _, part = self._at(path + "._part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not fs.rename(part, where):
            raise OSError(f"can't write {path}")

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        source = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def changed(self, path: str) -> list[tuple[str, float]]:
        """Names below a folder and when they last changed, in seconds of the epoch."""
        fs, where = self._at(path)
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(where)) if fs.exists(where) else []

    def publish(self, path: str, text: str) -> bool:
        """Give text a name unless it is taken; of several writers one succeeds. Whoever sees the name sees the whole text."""
        fs, where = self._at(path)
        hidden = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        self.write(hidden, text)
        try:
            if fs.getScheme() == "file":
                local = lambda p: self._at(p)[1].toUri().getPath()
                try:
                    os.link(local(hidden), local(path))
                except FileExistsError:
                    return False
                return True
            return not fs.exists(where) and bool(fs.rename(self._at(hidden)[1], where))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.delete(hidden)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
