"""Small files next to the data, through Hadoop's file systems, so that any store that Spark reads will do.

A file appears whole or not at all, and only one writer gets a name. Local files are written under another name and
linked to theirs, which fails where it is taken; HDFS and its like rename, which never replaces there. Object stores
have no such rename, but a file there appears when it is closed; that only one writer gets a name then rests on the
store's exclusive creation (conditional puts), which must be on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Stores where a file appears when it is closed, and where renaming copies.
OBJECT_STORES = ("s3", "s3a", "gs", "wasb", "wasbs", "oss")
#: From so many files on Spark reads them, not the driver.
MANY = 64


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.scheme = self.fs.getUri().getScheme()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _write(self, path, text: str) -> None:
        out = self.fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, source, target) -> bool:
        if self.scheme != "file":
            return bool(self.fs.rename(source, target))
        local = [self.jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0)) for p in (target, source)]
        try:
            self.jvm.java.nio.file.Files.createLink(*local)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def create(self, name: str, text: str) -> bool:
        """Writes a file; False if it is there already. The commit point of every writer."""
        target = self._path(name)
        if self.fs.exists(target):
            return False
        if self.scheme in OBJECT_STORES:
            try:
                self._write(target, text)
            except Exception:
                if self.fs.exists(target):
                    return False
                raise
            return True
        folder, _, base = name.rpartition("/")
        draft = self._path(f"{folder}/.{base}-{uuid.uuid4().hex}")
        self._write(draft, text)
        try:
            return self._publish(draft, target)
        finally:
            self.fs.delete(draft, False)

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_all(self, names: list[str]) -> list[str]:
        """Contents in the order of the names, which must sort."""
        if len(names) < MANY:
            return [self.read(n) for n in names]
        found = self.spark.read.option("wholetext", True).text([f"{self.root}/{n}" for n in names])
        return [r["value"] for r in found.select("value", "_metadata.file_name").orderBy("file_name").collect()]

    def names(self, folder: str) -> list[str]:
        """Names of the files in a folder, in order; drafts don't count."""
        if not self.exists(folder):
            return []
        found = (s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def make(self, folder: str = "") -> None:
        self.fs.mkdirs(self._path(folder))
