"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside groups.

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``; null counts as the empty text. Of equal texts the row with the
most code points in its original text stays, then the one with the smallest id (a
null id counts as the smallest). Of repeated rows (same id, same text) one stays.
An empty table gives an empty result. Very long texts are hashed whole. Columns other than id
and text are ignored by ``exact_groups`` and kept by ``drop_copies``, whatever their names.

Only ids, lengths and hashes are grouped, with partial aggregation before the
shuffle, so a group that holds a third of all rows costs one row per task. Bytes are
compared by grouping on (hash, normalised text): copies collapse inside each map
task, and a hash that keeps more than one text afterwards is a collision. Groups of
colliding hashes are then told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored, text_or_empty, whole_row, without_white


def content_hash(normalised: Column) -> Column:
    """128 bits of the normalised text, as hex."""
    return F.md5(normalised)


def collisions(docs: DataFrame, text_col: str, hasher: Callable[[Column], Column]) -> DataFrame:
    """``__hash, __texts`` of every hash that different texts share."""
    norm = without_white(text_or_empty(text_col))
    texts = docs.select(norm.alias("__norm")).select(hasher(F.col("__norm")).alias("__hash"), "__norm")
    distinct = texts.groupBy("__hash", "__norm").agg(F.count(F.lit(1)).alias("__n"))
    return distinct.groupBy("__hash").agg(F.count(F.lit(1)).alias("__texts")).where("__texts > 1")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hasher: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    ``hasher`` may be any hash, even a weak one: the result does not depend on it.
    """
    norm = without_white(text_or_empty(text_col))
    base = docs.select(
        F.col(id_col).alias("__id"),
        F.length(text_or_empty(text_col)).cast("long").alias("__len"),
        norm.alias("__norm"),
    )
    several = stored(collisions(docs, text_col, hasher), "exact-collisions")
    key = hasher(F.col("__norm"))
    if several.isEmpty():
        base = base.select("__id", "__len", key.alias("__key"), F.sha2("__norm", 256).alias("__sha"))
    else:
        # Rows of a colliding hash are grouped by hash and whole text.
        base = (
            base.withColumn("__hash", key)
            .join(several.withColumn("__hit", F.lit(True)), "__hash", "left")
            .select(
                "__id",
                "__len",
                F.when(F.col("__hit"), F.concat_ws(":", "__hash", "__norm")).otherwise(F.col("__hash")).alias("__key"),
                F.sha2("__norm", 256).alias("__sha"),
            )
        )
    rows = stored(base, "exact-rows")
    groups = stored(
        rows.groupBy("__key").agg(
            F.min(F.struct((-F.col("__len")).alias("l"), F.col("__id").alias("i"))).alias("__best"),
            F.count(F.lit(1)).alias("__size"),
        ),
        "exact-groups",
    )
    # Rows that are the same in id and key are told apart by their number.
    same = Window.partitionBy("__key", "__id").orderBy(F.col("__len").desc())
    return (
        rows.withColumn("__nth", F.row_number().over(same))
        .join(groups, "__key")
        .select(
            F.col("__id").alias(id_col),
            F.col("__best.i").alias("keep_id"),
            F.col("__size").alias("group_size"),
            (F.col("__id").eqNullSafe(F.col("__best.i")) & (F.col("__nth") == 1)).alias("kept"),
            F.col("__sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = stored(exact_groups(docs, id_col, text_col), "exact-decisions")
    stay = groups.where("kept").select(F.col(id_col).alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    text = text_or_empty(text_col)
    keys = docs.select(
        whole_row(docs), F.col(id_col).alias("id"), F.sha2(without_white(text), 256).alias("sha"), F.length(text).alias("length")
    )
    # Copies with other ids never meet in the join: its key holds the id as well.
    joined = keys.join(stay, (F.col("sha") == F.col("keep_sha")) & F.col("id").eqNullSafe(F.col("keep_id")))
    if not groups.where(~F.col("kept") & F.col(id_col).eqNullSafe(F.col("keep_id"))).isEmpty():
        # The kept id itself is repeated: of its rows the longest stays.
        nth = Window.partitionBy("keep_sha", "keep_id").orderBy(F.col("length").desc())
        joined = joined.withColumn("nth", F.row_number().over(nth)).where("nth = 1")
    return joined.select("row.*")
