"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes every character of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables; always through Spark's reader, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one. Only where it is unset
    (tests on one machine) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


#: Bytes of an Arrow batch that goes to a Python worker; texts are long and workers are many.
BATCH_BYTES = 4 << 20
#: Rows, and bytes of text, that a worker turns into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20

Batches = Iterator[pa.RecordBatch]


def released() -> None:
    """Gives the memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow`` with bounded memory, the same for every operator of this package.

    Batches are limited by bytes (a setting of the session), so that memory does not follow
    text lengths. Workers live on between tasks: at the end of a partition each gives back
    what the partition took, so that stages after it find the memory free.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @functools.wraps(run)
    def tidy(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(tidy, schema)


def sliced(batch: pa.RecordBatch, text_at: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Batches:
    """The batch in slices of bounded rows and bytes of text; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(sizes, done + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def fields(df: DataFrame, names: Iterable[str]) -> str:
    """The columns as a schema string."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``: helper columns beside it clash with none; ``row.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of few and narrow columns that one task takes, and tasks that take a table at least.
TASK_ROWS, LEAST_TASKS = 250_000, 16


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of narrow rows and about ``rows`` of them, in no more tasks than these ask for.

    What a join or a grouping leaves in all shuffle partitions is computed and written by few
    tasks while it is small; the number of tasks grows with the rows.
    """
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def text_or_empty(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_white(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]."""
    return F.translate(text, WHITE, "")
