"""Small files and folders through Hadoop's file system: wherever Spark writes tables, local or not.

Only commit records and lists of names go this way; they are read and written by the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder, with paths relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, none if it is not there."""
        if not self.exists(name):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._path(name)))

    def files(self, name: str, suffix: str = ".parquet") -> list[str]:
        """Paths, relative to the folder, of all files below ``name``."""
        if not self.exists(name):
            return []
        found, listed = [], self._fs.listFiles(self._path(name), True)
        start = len(self._fs.makeQualified(self._path("")).toString().rstrip("/")) + 1
        while listed.hasNext():
            path = listed.next().getPath().toString()
            if path.endswith(suffix):
                found.append(path[start:])
        return sorted(found)

    def write_json(self, name: str, value: dict) -> bool:
        """Writes a value under a name that is not in use, all at once; False if it is in use."""
        target = self._path(name)
        if self._fs.exists(target):
            return False
        made = self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(made, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        return self._fs.rename(made, target)

    def read_json(self, name: str) -> dict | None:
        """The value under a name, None if there is none."""
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def remove(self, name: str) -> bool:
        """Removes a file or a folder with all that is in it."""
        return self._fs.delete(self._path(name), True)
