"""Containment, corpus profile and retrieval metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_body, normalised, stripped, word_count

#: How far a containment rate may fall below its baseline.
TOLERANCE = 0.03


def context_containment(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """``case_id, type, hit`` for cases whose article is there: does any of its chunks hold the context?

    Chunks are normalised once each; the substring test runs only within an article.
    """
    texts = chunks.select("type", "article_slug", normalised(F.col("text")).alias("norm"))
    wanted = cases.select("case_id", "type", "article_slug", normalised(F.col("context")).alias("context"))
    hit = F.coalesce(F.contains("norm", "context"), F.lit(False))
    return wanted.join(texts, ["type", "article_slug"]).groupBy("case_id", "type").agg(F.bool_or(hit).alias("hit"))


def containment_gate(hits: DataFrame, baselines: Mapping[str, float], tolerance: float = TOLERANCE) -> DataFrame:
    """Per type: hits, cases, rate and whether it holds the baseline (types without one always do)."""
    floor = F.create_map(*[F.lit(x) for k, v in baselines.items() for x in (k, float(v))])[F.col("type")] - tolerance
    rates = hits.groupBy("type").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    rate = F.col("hits") / F.col("total")
    return rates.select("type", "hits", "total", F.round(rate, 6).alias("rate"), F.coalesce(rate >= floor, F.lit(True)).alias("ok"))


def corpus_profile(sections: DataFrame, texts_over_cap: DataFrame) -> DataFrame:
    """Per type: files, sections per file, median and 90th percentile of section lengths, share over the cap.

    ``sections``: ``type, article_slug, content``; ``texts_over_cap``: ``type, over``.
    """
    size = F.length("content")
    lengths = sections.groupBy("type").agg(
        F.count_distinct("article_slug").alias("files"),
        (F.count(F.lit(1)) / F.count_distinct("article_slug")).alias("sections_per_file"),
        F.percentile(size, 0.5).alias("median_chars"),
        F.percentile(size, 0.9).alias("p90_chars"),
    )
    return lengths.join(texts_over_cap.groupBy("type").agg(F.avg(F.col("over").cast("int")).alias("split_rate")), "type")


#: Size parameter of the length sketches: ranks of their quantiles are off by 1.65 % or less, with 99 % confidence.
SKETCH_K = 200


def profile_sketches(sections: DataFrame, buckets: int = 64, k: int = SKETCH_K) -> DataFrame:
    """Per type and bucket of articles: files, sections, and a sketch of section lengths, some kilobytes each.

    An article lies in one bucket, so a delivery asks only for its buckets to be made anew (see
    ``refreshed_sketches``), and sketches of any buckets can be merged.
    """
    bucket = F.pmod(F.xxhash64("type", "article_slug"), F.lit(buckets)).cast("int").alias("bucket")
    lengths = sections.select("type", bucket, "article_slug", F.length("content").cast("long").alias("size"))
    return lengths.groupBy("type", "bucket").agg(
        F.count_distinct("article_slug").alias("files"), F.count(F.lit(1)).alias("sections"), F.kll_sketch_agg_bigint("size", k).alias("lengths")
    )


def refreshed_sketches(sketches: DataFrame, touched: DataFrame, sections: DataFrame, buckets: int = 64, k: int = SKETCH_K) -> DataFrame:
    """``sketches`` with the buckets of the articles ``touched`` made anew from ``sections`` (all that these buckets now hold)."""
    bucket = F.pmod(F.xxhash64("type", "article_slug"), F.lit(buckets)).cast("int").alias("bucket")
    hit = touched.select("type", bucket).distinct()
    # As many rows as there are types and buckets, at most.
    own = sections.join(F.broadcast(hit), (sections["type"].eqNullSafe(hit["type"])) & (F.pmod(F.xxhash64(sections["type"], sections["article_slug"]), F.lit(buckets)) == hit["bucket"]), "left_semi")
    kept = sketches.alias("s").join(F.broadcast(hit.alias("h")), F.expr("s.type <=> h.type AND s.bucket = h.bucket"), "left_anti")
    return kept.unionByName(profile_sketches(own, buckets, k))


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """Per type: files, sections per file, and the median and 90th percentile of section lengths by merged sketches."""
    merged = sketches.groupBy("type").agg(F.sum("files").alias("files"), F.sum("sections").alias("sections"), F.kll_merge_agg_bigint("lengths").alias("lengths"))
    quantile = lambda q: F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))
    return merged.select(
        "type", "files", (F.col("sections") / F.col("files")).alias("sections_per_file"), quantile(0.5).alias("median_chars"), quantile(0.9).alias("p90_chars")
    )


def chunk_invariants(chunks: DataFrame, cap: int) -> DataFrame:
    """One row: chunks over the cap, with an empty body, and repeated ids."""
    return chunks.agg(
        F.count_if(F.col("token_count") > cap).alias("over_cap"),
        F.count_if(stripped(chunk_body(F.col("text"))) == "").alias("empty_body"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicate_ids"),
    )


def longest_chunk(chunks: DataFrame, segmented: str = "text") -> DataFrame:
    """The largest token count of segmented chunks, with the (smallest) id that has it."""
    counted = chunks.select("id", word_count(F.col(segmented)).alias("tokens"))
    best = counted.agg(F.min(F.struct((-F.col("tokens")).alias("m"), "id")).alias("b"))
    return best.select((-F.col("b.m")).alias("max_tokens"), F.col("b.id").alias("id"))


def sample_per_type(cases: DataFrame, per_type: int, seed: int = 42) -> DataFrame:
    """At most ``per_type`` cases of each type, in the order of a seeded hash of their id."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("case_id").cast("string")))
    by_type = Window.partitionBy("type").orderBy(order, "case_id")
    return cases.withColumn("__n", F.row_number().over(by_type)).where(F.col("__n") <= per_type).drop("__n")


def first_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``type, mode, case_id, article_rank, chunk_rank``: first right article, first chunk with the context.

    ``hits``: ``mode, case_id, rank, hit_type, hit_slug, text``. Every case counts in every
    mode; ranks are null where nothing was found. A null context is a miss.
    """
    modes = hits.select("mode").distinct()
    wanted = cases.select("case_id", "type", "article_slug", normalised(F.col("context")).alias("context"))
    right = (F.col("hit_type") == F.col("type")) & (F.col("hit_slug") == F.col("article_slug"))
    holds = F.contains(normalised(F.col("text")), F.col("context"))
    ranks = wanted.join(hits, "case_id").groupBy("case_id", "mode").agg(
        F.min(F.when(right, F.col("rank"))).alias("article_rank"), F.min(F.when(holds, F.col("rank"))).alias("chunk_rank")
    )
    # Modes are a handful of names.
    every = wanted.select("case_id", "type").join(F.broadcast(modes), F.lit(True))
    return every.join(ranks, ["case_id", "mode"], "left").select("type", "mode", "case_id", "article_rank", "chunk_rank")


def eval_summary(records: DataFrame, k: int = 5) -> DataFrame:
    """Per type and mode, and pooled (type ``all``): n, article@k, chunk@1, chunk@k and MRR."""
    records.createOrReplaceTempView("__eval_records")
    return records.sparkSession.sql(
        f"""
        SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, mode, count(*) AS n,
          round(avg(CASE WHEN article_rank <= {k} THEN 1.0D ELSE 0.0D END), 6) AS article_at_k,
          round(avg(CASE WHEN chunk_rank = 1 THEN 1.0D ELSE 0.0D END), 6) AS chunk_at_1,
          round(avg(CASE WHEN chunk_rank <= {k} THEN 1.0D ELSE 0.0D END), 6) AS chunk_at_k,
          round(avg(coalesce(1.0D / chunk_rank, 0.0D)), 6) AS mrr
        FROM __eval_records GROUP BY GROUPING SETS ((type, mode), (mode))
        """
    )


def smoke_rates(records: DataFrame, k: int = 5) -> DataFrame:
    """Per type and mode: shares of cases with the right article and with the context among k hits."""
    rate = lambda c: F.round(F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0)), 6)
    return records.groupBy("type", "mode").agg(rate("article_rank").alias("article_rate"), rate("chunk_rank").alias("chunk_rate"))
