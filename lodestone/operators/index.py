"""The chunk index: writing and reading it, replacing by article, checks and counts.

An index row is a chunk with ``dense`` and ``sparse``. On disk it is the table ``chunks`` of a
store (see ``store``), beside what else a build keeps: postings, the articles' versions,
quarantined articles and counts of terms.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import store
from lodestone.operators.store import KEY, SPLIT_ROWS, IndexMismatch
from lodestone.sources.tables import materialised, temporary

CHUNKS = "chunks"


def write_index(index: DataFrame, path: str, split_rows: int = SPLIT_ROWS, placed: bool = False) -> store.Snapshot:
    """The whole index anew, as a store of one table. Rows are made once, then counted and dealt out.

    ``placed``: they are chunks as ``chunk_articles`` deals them, and are written where they lie.
    """
    with temporary(index.sparkSession):
        return store.create(index.sparkSession, path, {CHUNKS: materialised(index, "index-rows")}, split_rows=split_rows, placed=(CHUNKS,) if placed else ())


def opened(spark: SparkSession, path: str) -> store.Snapshot:
    """The index as it is now; what is written later is not seen through it."""
    found = store.snapshot(spark, path)
    if found is None:
        raise FileNotFoundError(f"no index at {path}")
    return found


def read_index(spark: SparkSession, path: str, types: Iterable[str] | None = None, name: str = CHUNKS) -> DataFrame:
    """The index's rows (or those of another table of its store); with ``types`` only their folders are read."""
    return opened(spark, path).table(name, types)


def replace_articles(index: DataFrame, keys: DataFrame, new: DataFrame) -> DataFrame:
    """``index`` without the articles in ``keys``, plus ``new``; an article without new rows is removed."""
    kept = index.join(keys.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def article_status(chunks: DataFrame, dimension: int, vector: str = "dense") -> DataFrame:
    """Per article: how many chunks, how many with a vector of the right size, and whether all have."""
    valid = F.coalesce(F.size(vector) == dimension, F.lit(False))
    return chunks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(valid).alias("n_valid")).withColumn(
        "ok", F.col("n_chunks") == F.col("n_valid")
    )


def isolate_failed(chunks: DataFrame, dimension: int, vector: str = "dense") -> tuple[DataFrame, DataFrame]:
    """The chunks of articles that were embedded wholly, and the keys of the other articles."""
    status = article_status(chunks, dimension, vector)
    good = chunks.join(status.where("ok").select(*KEY), KEY, "left_semi")
    return good, status.where("not ok").select(*KEY, "n_chunks", "n_valid")


def checked(index: DataFrame, expected: StructType, dimension: int | None = None) -> DataFrame:
    """``index``, if it has the columns and types of ``expected`` and only vectors of ``dimension``; else an error says what is wrong."""
    wrong = store.differences(index.schema, expected)
    if not wrong and dimension is not None:
        sizes = schema_report(index, dimension).first()
        if not sizes["ok"] and sizes["min_dim"] is not None:
            wrong = [f"vectors of {sizes['min_dim']} to {sizes['max_dim']} numbers instead of {dimension}"]
    if wrong:
        raise IndexMismatch("; ".join(wrong))
    return index


def schema_differences(index: DataFrame, expected: StructType) -> list[str]:
    """What an index lacks or has otherwise than ``expected``: names and types, by column."""
    have = {f.name: f.dataType.simpleString() for f in index.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    return [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in want.items() if have.get(n) != t]


def schema_report(index: DataFrame, dimension: int) -> DataFrame:
    """One row: smallest and largest vector, whether both columns are there and the size is right."""
    names = set(index.columns)
    size = F.size("dense") if "dense" in names else F.lit(None).cast("int")
    sizes = index.agg(F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))
    right = (F.col("min_dim") == dimension) & (F.col("max_dim") == dimension) & F.lit("sparse" in names)
    return sizes.withColumn("ok", F.coalesce(right, F.lit(False)))


def invariant_problems(expected: DataFrame, index: DataFrame, dimension: int) -> DataFrame:
    """``id, problem``: one row per broken rule.

    ``expected``: ``id, type, article_slug, has_terms``; ``index``: index rows. Vectors
    do not go through the join, only their sizes do.
    """
    want = expected.select("id", *[F.col(c).alias(f"w_{c}") for c in (*KEY, "has_terms")], F.lit(True).alias("wanted"))
    have = index.select("id", *KEY, F.size("dense").alias("dim"), F.col("sparse").isNotNull().alias("has_sparse"), F.lit(True).alias("there"))
    both = want.join(have, "id", "full_outer")
    present = F.col("wanted").isNotNull() & F.col("there").isNotNull()
    rules = [
        (F.col("there").isNull(), "missing"),
        (F.col("wanted").isNull(), "unexpected"),
        (F.col("there").isNotNull() & (F.coalesce("dim", F.lit(-1)) != dimension), "dimension"),
        (present & (F.col("has_sparse") != F.col("w_has_terms")), "sparse"),
        (present & ((F.col("type") != F.col("w_type")) | (F.col("article_slug") != F.col("w_article_slug"))), "payload"),
    ]
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    repeated = index.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    return both.select("id", F.explode(broken).alias("problem")).distinct().unionByName(repeated)


def id_differences(expected: DataFrame, index: DataFrame) -> DataFrame:
    """``id, side``: ids that only one of the tables has."""
    missing = expected.select("id").exceptAll(index.select("id").distinct())
    extra = index.select("id").distinct().exceptAll(expected.select("id"))
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("unexpected")))


def ingest_report(status: DataFrame, index: DataFrame) -> DataFrame:
    """One row: articles by outcome, points written, chunks expected, points in the index."""
    own = status.agg(
        F.count_if("ok").alias("articles_ok"),
        F.count_if(~F.col("ok")).alias("articles_failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_chunks"))), F.lit(0)).alias("points_upserted"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("expected_chunks"),
    )
    return own.join(index.agg(F.count(F.lit(1)).alias("index_points")), F.lit(True))


def index_count(index: DataFrame) -> DataFrame:
    return index.groupBy("type").agg(F.count(F.lit(1)).alias("points"))
