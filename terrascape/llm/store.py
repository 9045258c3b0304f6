"""Tables that cut lineage, kept in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: a new temporary folder in local mode (tests, one machine), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='terrascape-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Stash:
    """Written tables of one run; each cuts lineage and survives lost executors. Results read them, so they stay until the application ends, and go then."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        at, files = self._at(self.root)
        files.mkdirs(at)
        files.deleteOnExit(at)

    def _at(self, path: str):
        """The path for Hadoop, and the file system it is in."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes df and reads it back. Shuffle files of the write go when it ends, where Spark can do so. by: a column whose values get folders of their own (see part)."""
        path, key = self.path(name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def part(self, kept: DataFrame, by: str, value: str) -> DataFrame:
        """The rows of one value of a table that was kept by that column, without the column; drop() deletes them alone."""
        path = f"{kept._stash_path}/{by}={value}"
        schema = kept.drop(by).schema
        at, files = self._at(path)
        out = self.spark.read.schema(schema).parquet(path) if files.exists(at) else self.spark.createDataFrame([], schema)
        out._stash_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in tables:
            at, files = self._at(df._stash_path)
            files.delete(at, True)
