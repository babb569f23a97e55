"""Small files and folders beside the tables, in whatever file system Spark uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The file system of a path, through the Hadoop client that Spark carries."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(root).getFileSystem(conf)

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def names(self, folder: str) -> list[str]:
        """What a folder holds; nothing if there is none."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def size(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write a file under another name, then give it its own: readers see all or nothing."""
        folder, _, name = path.rpartition("/")
        written = self._path(f"{folder}/.{name}.new")
        stream = self._fs.create(written, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(written, self._path(path)):
            self._fs.delete(written, False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
