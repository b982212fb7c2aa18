"""A table that grows by whole batches: staged files, and one small manifest file for each version that makes them visible.

A batch is written to a folder of its own and becomes part of the table when its manifest is put in place by a rename.
What was staged and never named by a manifest is not read. A batch has a key; one whose key is there already changes
nothing. Any version can be read. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Versions:
    """The table at ``path``, a folder of any file system that Spark knows, with rows of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifest"))

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def log(self, version: int | None = None) -> list[dict]:
        """What each version added, in order: ``version``, ``key``, ``folder``, ``whole``; one for each batch."""
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path("manifest")))
        wanted = [f"{self.path}/manifest/{n}" for n in names if n.endswith(".json") and (version is None or int(n[:-5]) <= version)]
        if not wanted:
            return []
        rows = self.spark.read.schema("version long, key string, folder string, whole boolean").json(wanted).collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["version"])

    @property
    def version(self) -> int:
        """The latest version; 0 before the first batch."""
        return max((r["version"] for r in self.log()), default=0)

    def stage(self, rows: DataFrame) -> str:
        """Write ``rows`` where no reader looks; the folder's name."""
        folder = f"data/{uuid4()}"
        rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, key: str, folder: str, whole: bool = False) -> int:
        """Make a staged folder part of the table, or with ``whole`` all of it from now on; the new version."""
        version = self.version + 1
        staged, name = f"manifest/.{uuid4()}", f"manifest/{version:012d}.json"
        out = self._fs.create(self._path(staged), False)
        out.write(bytearray(json.dumps({"version": version, "key": key, "folder": folder, "whole": whole}).encode()))
        out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(staged), self._path(name)):
            raise RuntimeError(f"version {version} is there already: another writer was faster")
        return version

    def append(self, rows: DataFrame, key: str) -> int:
        """Add ``rows`` all at once; nothing happens if a batch of this ``key`` is there. The version after it."""
        log = self.log()
        if any(r["key"] == key for r in log):
            return log[-1]["version"]
        return self.commit(key, self.stage(rows))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version``, by default the latest."""
        log = self.log(version)
        start = max((i for i, r in enumerate(log) if r["whole"]), default=0)
        folders = [f"{self.path}/{r['folder']}" for r in log[start:]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
