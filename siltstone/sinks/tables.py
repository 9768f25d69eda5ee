"""The store: one parquet table per name, replaced by versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FILES = "path string, repository string, content_hash string, mtime_ns long, size_bytes long, indexed_at timestamp, parse_error string"
VECTORS = "unit_id string, provider string, content_hash string, dimensions int, vector array<float>"
NODES = "node_id string, node_type string, path string, label string, unit_id string"
EDGES = "source_id string, target_id string, edge_type string, confidence double"
COMMITS = "commit_hash string, authored_at timestamp, author_name string, message string, files array<struct<path:string,additions:int,deletions:int,status:string,old_path:string>>"


class Store:
    """Named tables below a folder; a write makes a new version and then moves the pointer.

    A reader keeps the version it opened, a failed write leaves the old one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.folder}/{name}/current"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, name: str) -> str | None:
        where, fs = self._fs(self._pointer(name))
        if not fs.exists(where):
            return None
        return self.spark.read.text(self._pointer(name)).first()[0]

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        v = self.version(name)
        if v is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema) if schema else self.spark.read
        return rows.parquet(f"{self.folder}/{name}/{v}")

    def write(self, name: str, rows: DataFrame, partition_by=()) -> DataFrame:
        v, before = uuid.uuid4().hex, self.version(name)
        target = f"{self.folder}/{name}/{v}"
        rows.write.partitionBy(*partition_by).parquet(target)
        self._move_pointer(name, v)
        self._forget(name, {v, before})
        return self.spark.read.schema(rows.schema).parquet(target)

    def _move_pointer(self, name: str, version: str) -> None:
        """Write the pointer aside and rename it over the old one, which is one step of the file system."""
        sc = self.spark.sparkContext
        aside, fs = self._fs(f"{self._pointer(name)}.{version}")
        out = fs.create(aside, True)
        out.write(bytearray(version, "ascii"))
        out.close()
        rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
        options = sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        target = fs.makeQualified(self._fs(self._pointer(name))[0])
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), target, options)

    def _forget(self, name: str, kept: set) -> None:
        """Delete all versions but the current one and the one before, which readers may still hold."""
        where, fs = self._fs(f"{self.folder}/{name}")
        for status in fs.listStatus(where):
            if status.isDirectory() and status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
