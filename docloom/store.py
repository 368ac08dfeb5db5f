"""Stored tables as Parquet snapshots: a version is written beside the last one, and a pointer then flips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Named tables below one folder of any file system that Spark reads.

    A reader sees the old or the new version of a table, never a mixture, and
    a crash at any moment leaves one of both.
    Two writers of one table must take turns.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[str]:
        """Names of the pointer files, the last flip first; one that a crash left half written has another name."""
        folder = self._path(f"{self.root}/{name}")
        if not self._files().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files().listStatus(folder)]
        return sorted((n for n in names if n.startswith("current-")), reverse=True)

    def version(self, name: str) -> str | None:
        pointers = self._pointers(name)
        return self.spark.read.text(f"{self.root}/{name}/{pointers[0]}").first()[0] if pointers else None

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version, or an empty table of the given schema where there is none."""
        version = self.version(name)
        if version is None:
            if schema is None:
                raise FileNotFoundError(f"no table {name} in {self.root}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> str:
        """Write a version and flip to it: a new pointer of the next number appears by a rename, and only then do older ones go."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        files, temporary, older = self._files(), self._path(f"{self.root}/{name}/next-{version}"), self._pointers(name)
        out = files.create(temporary, True)
        out.write(bytearray(version.encode()))
        out.close()
        number = int(older[0].split("-")[1]) + 1 if older else 0
        if not files.rename(temporary, self._path(f"{self.root}/{name}/current-{number:012d}")):
            raise OSError(f"could not flip {name} to {version}")
        for old in older[1:]:  # the last one stays for those who have just listed it
            files.delete(self._path(f"{self.root}/{name}/{old}"), False)
        return version
