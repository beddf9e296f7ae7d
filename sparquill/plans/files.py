"""Small files and folders on whatever file system a path names, as Spark's own readers see it."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """Files through the session's Hadoop configuration; a path without a scheme is the default system's."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        """Give a path a name that is free; ``OSError`` if the system refuses."""
        fs, p = self._at(old)
        if not fs.rename(p, self._at(new)[1]):
            raise OSError(f"{old} can't be renamed to {new}")

    def read_json(self, path: str, default):
        """The file's value, or ``default`` for a missing or damaged file or another type."""
        try:
            fs, p = self._at(path)
            stream = fs.open(p)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            value = json.loads(text)
        except Exception:
            return default
        return value if isinstance(value, type(default)) else default

    def write_json(self, path: str, value) -> None:
        """Write beside the file, then replace it, so that a reader never sees a half."""
        fs, part = self._at(f"{path}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
        finally:
            stream.close()
        self.delete(path)
        self.rename(f"{path}.part", path)
