"""Article files, QA case files and chat histories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<n:int,title:string,url:string,section_path:string,type:string,text:string,score:double>"
HISTORY = (
    "array<struct<id:string,title:string,createdAt:bigint,messages:array<struct<"
    f"id:string,role:string,text:string,sources:array<{SOURCE}>,error:boolean,pending:boolean>>>>"
)
#: Bytes that opening an article file counts as, when files are dealt to tasks.
OPEN_BYTES = 64 << 10
OPEN_COST, _OPEN_DEFAULT = "spark.sql.files.openCostInBytes", "4194304b"
CASE_SCHEMA = "question string, answer string, context string, article_url string"


def file_name() -> Column:
    """The path of a row's file. Spark gives it percent-encoded; ``+`` is an ordinary character there."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def named_articles(files: DataFrame, *more: Column) -> DataFrame:
    """``article_type, article_slug, text`` (and more) of whole text files ``<type>/<slug>.txt``."""
    name = file_name()
    return files.select(
        F.regexp_extract(name, r"(?s)([^/]+)/[^/]+\.txt$", 1).alias("article_type"),
        F.regexp_extract(name, r"(?s)([^/]+)\.txt$", 1).alias("article_slug"),
        F.col("value").alias("text"),
        *more,
    )


def type_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of types below ``path`` (which may be a pattern), to be read whole.

    Of a pattern that names the files themselves Spark looks up every single one again, in a job of its own.
    """
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*")
    there = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or ()
    # What means something in a pattern is escaped; without any folder Spark says what is not there.
    return [re.sub(r"([][*?{}\\])", r"\\\1", f.getPath().toString()) for f in there if f.isDirectory()] or [f"{path}/*/*.txt"]


def small_files_cost(spark: SparkSession) -> str:
    """What opening a file counts as where files are some kilobytes each: what the session says, or else ``OPEN_BYTES``."""
    now = spark.conf.get(OPEN_COST)
    return str(OPEN_BYTES) if now == _OPEN_DEFAULT else now


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """``article_type, article_slug, text`` of ``<path>/<type>/<slug>.txt``, one row per file.

    Files are some kilobytes each: unless the session says what opening one costs, it counts as ``OPEN_BYTES``, so a
    task reads up to some thousands (at Spark's own 4 MB it would be 32, and most of the time would go into tasks).
    """
    spark.conf.set(OPEN_COST, small_files_cost(spark))
    return named_articles(spark.read.text(type_folders(spark, path), wholetext=True, pathGlobFilter="*.txt"))


def article_names(spark: SparkSession, path: str) -> DataFrame:
    """``article_type, article_slug`` of the files that there are; none of them is opened."""
    spark.conf.set(OPEN_COST, small_files_cost(spark))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(type_folders(spark, path))
    return named_articles(files.withColumn("value", F.lit(None).cast("string"))).drop("text")


def write_articles(articles: DataFrame, path: str) -> None:
    """``<path>/<type>/<slug>.txt`` for every article; the folder must be one that all executors share.

    Files are written under their own names, so a task that runs twice leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders: dict[str, tuple[pafs.FileSystem, str]] = {}
        for batch in batches:
            for kind, slug, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind not in folders:
                    folders[kind] = pafs.FileSystem.from_uri(f"{path if ':' in path else f'file://{path}'}/{quote(kind)}")
                    folders[kind][0].create_dir(folders[kind][1], recursive=True)
                fs, folder = folders[kind]
                with fs.open_output_stream(f"{folder}/{slug}.txt", compression=None) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = articles.select("article_type", "article_slug", "text").mapInArrow(run, "n long")
    written.agg(F.sum("n")).collect()


def read_qa_cases(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """Cases of ``<path>/<type>.csv`` (a file or a folder of parts); files with a header only give none."""
    rows = spark.read.schema(schema).csv(
        path, header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter="*.csv"
    )
    return rows.select("*", F.regexp_extract(file_name(), r"([^/]+)\.csv(?:/[^/]*)?$", 1).alias("article_type"))


def load_conversations(raw: Column) -> Column:
    """A stored history as an array; anything but a JSON array is an empty one."""
    parsed = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, HISTORY))
    return F.coalesce(parsed, F.array().cast(HISTORY))


def save_conversations(history: Column) -> Column:
    """A history as JSON, without messages that are still pending."""

    def settled(conversation: Column) -> Column:
        kept = F.filter(conversation["messages"], lambda m: ~F.coalesce(m["pending"], F.lit(False)))
        return conversation.withField("messages", kept)

    return F.to_json(F.transform(history, settled))
