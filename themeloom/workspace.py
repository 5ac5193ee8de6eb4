"""Intermediate tables in the shared folder of the cluster.

Iterative steps write each round's table and read it back. That cuts the lineage
and lets a job go on after executors are lost, with nothing kept only in their
memory or on their disks.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder. Only
    where neither is set and all executors are threads of this machine, a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="themeloom-")
    return _LOCAL_FOLDERS[context.applicationId]


class Workspace:
    """A folder of its own for the tables of one run."""

    def __init__(self, spark: SparkSession, root: str | None = None, run: str | None = None):
        self.spark = spark
        self.run = run or f"themeloom_{uuid.uuid4().hex[:12]}"
        self.folder = f"{(root or shared_folder(spark)).rstrip('/')}/{self.run}"

    def part(self) -> Workspace:
        """A new folder inside this one. Every job takes its own, so jobs that share a
        workspace never replace each other's tables."""
        return Workspace(self.spark, self.folder, f"{self.run}_{uuid.uuid4().hex[:6]}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the stored table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(
        self, df: DataFrame, name: str, key: str, buckets: int, split_by: str | None = None
    ) -> DataFrame:
        """Like ``table``, bucketed by ``key``: joins on it need no shuffle."""
        writer = df.write.mode("overwrite").format("parquet").option("path", self.path(name))
        if split_by:
            writer = writer.partitionBy(split_by)
        writer.bucketBy(buckets, key).saveAsTable(f"{self.run}_{name}")
        return self.spark.table(f"{self.run}_{name}")

    def reopened(self, path: str, name: str, key: str, buckets: int) -> DataFrame:
        """A table that ``bucketed`` wrote in an earlier session, bucketed as it is."""
        columns = self.spark.read.parquet(path).schema.toDDL()
        self.spark.sql(
            f"CREATE TABLE {self.run}_{name} ({columns}) USING parquet"
            f" CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(f"{self.run}_{name}")

    def drop(self, name: str) -> None:
        """Remove one table of this run."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.run}_{name}")
        self._delete(self.path(name))

    def close(self) -> None:
        """Remove everything this run wrote."""
        for table in self.spark.catalog.listTables():
            if table.name.startswith(self.run):
                self.spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: it is renamed when it is written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(text.encode())
    out.close()
    if not files.rename(draft, target):
        raise RuntimeError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The file written last of those that match."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []
    files = [(f.getModificationTime(), f.getPath().toString()) for f in found]
    return max(files)[1] if files else None
