"""A versioned store of tables in a folder: every change writes a new version and then moves the pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables as Parquet versions below ``root``; a reader of a version is never disturbed by a writer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str) -> dict | None:
        jvm, files = self._files()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT")
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, name: str, version: str) -> None:
        jvm, files = self._files()
        stream = files.create(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT"), True)
        stream.write(json.dumps({"version": version}).encode())
        stream.close()

    def exists(self, name: str) -> bool:
        return self._pointer(name) is not None

    def read(self, name: str) -> DataFrame:
        """The current version of a table."""
        pointer = self._pointer(name)
        if pointer is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{pointer['version']}")

    def write(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """A new version of a table; the old one stays readable for those who hold it."""
        version = f"v-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{version}")
        self._point(name, version)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to the current version, or begin the table with them."""
        pointer = self._pointer(name)
        if pointer is None:
            return self.write(name, rows)
        columns = self.read(name).columns
        rows.select(*columns).write.mode("append").parquet(f"{self.root}/{name}/{pointer['version']}")
        return None

    def upsert(self, name: str, rows: DataFrame, keys: list[str], keep_old: bool = False) -> None:
        """Replace rows of equal keys; a null in a new row keeps the old value if ``keep_old``."""
        if not self.exists(name):
            return self.write(name, rows)
        old = self.read(name)
        if keep_old:
            was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in old.columns if c not in keys])
            rows = rows.join(was, keys, "left").select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in old.columns if c not in keys])
        rest = old.join(rows.select(*keys), keys, "left_anti")
        return self.write(name, rest.unionByName(rows.select(*old.columns)))

    def insert_new(self, name: str, rows: DataFrame, keys: list[str], order: str | None = None) -> None:
        """Add only the rows whose keys are not there yet; of new rows of equal keys the first by ``order`` (else by all columns) is taken."""
        rest = [c for c in rows.columns if c not in keys]
        by = [order, *[c for c in rest if c != order]] if order else rest
        fresh = rows.groupBy(*keys).agg(F.min(F.struct(*by)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns) if rest else rows.distinct()
        if self.exists(name):
            fresh = fresh.join(self.read(name).select(*keys), keys, "left_anti")
        self.append(name, fresh.select(*rows.columns))

    def delete(self, name: str, where: str) -> None:
        """Remove the rows that meet an SQL condition; rows for which it is null stay."""
        if self.exists(name):
            self.write(name, self.read(name).where(f"coalesce(not ({where}), true)"))

    def delete_files(self, project_id: int, paths: DataFrame) -> None:
        """Remove the nodes of files (file_path) of a project and every edge and vector that touches them."""
        nodes = self.read("nodes")
        gone = nodes.where(F.col("project_id") == project_id).join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("node_id"))
        for name, columns in (("edges", ("source_node_id", "target_node_id")), ("vectors", ("node_id",)), ("node_pagerank", ("node_id",))):
            if self.exists(name):
                rows = self.read(name)
                for column in columns:
                    rows = rows.join(gone.withColumnRenamed("node_id", column), column, "left_anti")
                self.write(name, rows)
        self.write("nodes", nodes.join(gone.withColumnRenamed("node_id", "id"), "id", "left_anti"))

    def delete_project(self, project_id: int, tables: Sequence[str]) -> None:
        """Remove a project's rows from all named tables that exist."""
        for name in tables:
            self.delete(name, f"{'id' if name == 'projects' else 'project_id'} = {int(project_id)}")

    def export(self, target: str) -> None:
        """Copy the current version of every table to another folder, zstd-compressed."""
        jvm, files = self._files()
        for status in files.listStatus(jvm.org.apache.hadoop.fs.Path(self.root)):
            name = status.getPath().getName()
            if self.exists(name):
                self.read(name).write.mode("overwrite").option("compression", "zstd").parquet(f"{target.rstrip('/')}/{name}")

    def load(self, source: str, names: Sequence[str]) -> None:
        """Take tables from an exported folder; ``projects`` must be readable."""
        self.spark.read.parquet(f"{source.rstrip('/')}/projects").limit(1).collect()
        for name in names:
            self.write(name, self.spark.read.parquet(f"{source.rstrip('/')}/{name}"))
