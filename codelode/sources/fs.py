"""Small files below a table's folder, through the file systems that Spark's own readers and writers use."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder on any file system Hadoop knows: local, HDFS, an object store."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        """The path of a file or folder, for Spark's readers and writers."""
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file whole and then gives it its name; False, with nothing changed, if that name is taken."""
        tmp = f".{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(tmp), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self._fs.getUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(tmp), self._path(name), options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            if self._fs.exists(self._path(tmp)):
                self._fs.delete(self._path(tmp), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
