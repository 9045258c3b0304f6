"""Session settings and durable cuts of lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution, for tests and the bench; on a cluster the session is given."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("terrascape")
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: a temporary one in local mode, an error on a cluster, whose executors could not reach it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='terrascape-')}")
    return (named or context.getCheckpointDir()).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Checkpoints df there, so that its lineage ends and survives lost executors."""
    durable_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df kept for the passes within; only what is kept already stays kept afterwards."""
    fresh = df.storageLevel == StorageLevel.NONE
    if fresh:
        df.persist()
    try:
        yield df
    finally:
        if fresh:
            df.unpersist()
