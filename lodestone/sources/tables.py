"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared folder; a temporary one only on one machine where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    for made in getattr(_open, "folders", ()):
        made.append(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for tables that several branches of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, on whatever file system they are; ones that are not there are passed over."""
    for path in paths:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside (by this thread) are removed at the end, so results must be written by then."""
    folders: list[str] = []
    _open.folders = (*getattr(_open, "folders", ()), folders)
    try:
        yield
    finally:
        _open.folders = _open.folders[:-1]
        removed(spark, *folders)
