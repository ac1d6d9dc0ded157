"""Chat logs: turns, patches, citations and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import split_citations, title_of
from lodestone.sources.tables import materialised


def conversations_of(messages: DataFrame) -> DataFrame:
    """``conv_id, title, created_at, n_messages``; the title is the first message's."""
    return messages.groupBy("conv_id").agg(
        F.min_by(title_of(F.col("text")), "turn").alias("title"),
        F.min("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("n_messages"),
    )


def assemble_turns(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """The log with each question of ``asked (conv_id, text, created_at)`` and a pending answer appended."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("created_at", "text"))
    placed = asked.join(last, "conv_id", "left").withColumn("turn", F.coalesce("last", F.lit(-1)) + 2 * nth - 1)
    row = lambda role, text, shift, pending: placed.select(
        "conv_id", (F.col("turn") + shift).alias("turn"), F.lit(role).alias("role"), text.alias("text"), "created_at", F.lit(pending).alias("pending")
    )
    new = row("user", F.col("text"), 0, False).unionByName(row("assistant", F.lit(""), 1, True))
    return messages.select("conv_id", "turn", "role", "text", "created_at", F.lit(False).alias("pending")).unionByName(new)


def apply_patches(messages: DataFrame, patches: DataFrame) -> DataFrame:
    """Messages with the non-null columns of ``patches (conv_id, msg_id, ...)`` put in; unknown targets do nothing."""
    columns = [c for c in patches.columns if c not in ("conv_id", "msg_id")]
    renamed = patches.select("conv_id", "msg_id", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = messages.join(renamed, ["conv_id", "msg_id"], "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in messages.columns])


def citation_usage(answers: DataFrame) -> DataFrame:
    """Per answer (``msg_id, text, source_count``): citations, distinct sources cited, markers out of range, sources never cited."""
    parts = split_citations(F.col("text"), F.col("source_count"))
    cited = F.transform(F.filter("parts", lambda p: p["kind"] == "cite"), lambda p: p["n"])
    markers = F.regexp_count("text", F.lit(r"\[\d{1,9}\]"))
    counted = answers.withColumn("parts", parts).select("msg_id", "source_count", cited.alias("cited"), markers.alias("markers"))
    distinct = F.size(F.array_distinct("cited"))
    return counted.select(
        "msg_id",
        F.size("cited").alias("n_cites"),
        distinct.alias("n_cited_sources"),
        (F.col("markers") - F.size("cited")).alias("n_out_of_range"),
        (F.col("source_count") - distinct).alias("n_uncited"),
    )


def group_by_day(conversations: DataFrame, now_ms: int | Column) -> DataFrame:
    """Conversations, newest first, as ``today`` or ``previous`` by local midnight of the session's zone."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    midnight = F.unix_millis(F.date_trunc("day", F.timestamp_millis(now.cast("long"))))
    label = F.when(F.col("created_at") >= midnight, "today").otherwise("previous")
    return numbered(conversations.withColumn("day", label), "day", [F.desc("created_at"), F.asc("conv_id")], "position")


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``name``: from 1 in each group. A group may hold most of the rows: no task sorts it alone.

    Rows are dealt by ranges of group and order; in each range they are numbered on their
    own, and the counts of the ranges before (one row for each) are added.
    """
    ranged = rows.repartitionByRange(F.col(group), *order).withColumn("__range", F.spark_partition_id())
    ranged = materialised(ranged, "ranges")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order))
    both = ranged.withColumn("__nth", within).join(offsets, [group, "__range"])
    return both.withColumn(name, (F.col("__nth") + F.col("__before")).cast("int")).drop("__range", "__nth", "__before")


def sources_for(messages: DataFrame, selected: DataFrame) -> DataFrame:
    """``conv_id, sources``: those of the selected message, else of the latest message that has some."""
    latest = messages.groupBy("conv_id").agg(F.max_by("sources", F.when(F.col("sources").isNotNull(), F.col("turn"))).alias("latest"))
    chosen = messages.join(selected.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_semi").select("conv_id", F.col("sources").alias("chosen"))
    return latest.join(chosen, "conv_id", "left").select("conv_id", F.coalesce("chosen", "latest").alias("sources"))
