"""From articles to chunks, in one pass and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.sections import PART, parts_column, sections, whitespace_tokens
from lodestone.functions.text import after_url, chunk_id, context_header, parse_lines, unix_lines, with_context, word_count
from lodestone.operators.store import place

MAX_TOKENS = 400
#: Bytes of an input, as it is stored, that a task parses; above ``MANY_PARTS`` tasks up to ``LARGE_PART_BYTES``.
PART_BYTES, LARGE_PART_BYTES, MANY_PARTS = 8 << 20, 64 << 20, 4096
#: From here on Spark's estimate says that it does not know a size.
UNKNOWN_BYTES = 1 << 50
#: Bytes of texts that go to a Python worker at once, at most.
BATCH_BYTES = 4 << 20


def dealt(articles: DataFrame) -> DataFrame:
    """``articles`` over tasks of bounded size, however few files and row groups they come from.

    Partitions are ranges of the hash by which a store places articles, so that what is made of them
    lies by its leaves and is written to them without another shuffle (see ``store.place``).
    """
    if articles.isStreaming:
        return articles
    size = int(str(articles._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        return articles
    cores = articles.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, -(-size // LARGE_PART_BYTES), min(MANY_PARTS, -(-size // PART_BYTES)))
    return articles.repartitionById(parts, place(parts, "article_type", "article_slug"))


def parsed_articles(articles: DataFrame) -> DataFrame:
    """``article_type, article_slug`` with ``url, title, body`` (``parse_article``); each step is worked out once."""
    key = ("article_type", "article_slug")
    unix = articles.select(*key, unix_lines(F.col("text")).alias("unix")).select(*key, "unix", after_url(F.col("unix")).alias("rest"))
    return unix.select(*key, *[c.alias(n) for n, c in parse_lines(F.col("unix"), F.col("rest")).items()])


def section_rows(articles: DataFrame) -> DataFrame:
    """One row per section, in order: ``pos, breadcrumb, content`` beside the article's columns."""
    return (
        parsed_articles(articles)
        .select("article_type", "article_slug", "url", "title", F.posexplode(sections("body")).alias("pos", "s"))
        .select("article_type", "article_slug", "url", "title", "pos", "s.breadcrumb", "s.content")
    )


def article_chunks(
    articles: DataFrame,
    max_tokens: int | None = MAX_TOKENS,
    counter: Callable[[str], int] = whitespace_tokens,
    count_column: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """Chunks of every article with the number of their ``section``; some may be above the cap.

    A section above ``max_tokens`` is split into parts numbered ``i/n``. Sections are one array per article, which
    knows each one's first chunk, so nothing is shuffled. A header is repeated only in the rows that it is written to.
    ``counter`` and ``count_column`` are the same token count, per text and as a column.
    """
    batch_bytes = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(articles.sparkSession.conf.get(batch_bytes).rstrip("b")) > BATCH_BYTES:
        articles.sparkSession.conf.set(batch_bytes, str(BATCH_BYTES))
    parts = parts_column(F.col("title"), F.col("url"), F.col("body"), max_tokens, counter)
    own = ("article_type", "article_slug", "url", "title")
    found = parsed_articles(dealt(articles)).select(*own, F.explode(parts).alias("s")).select(*own, "s.*")
    adds_up = getattr(count_column, "adds_up", False)
    if adds_up:
        # The header is counted once for all parts of a section, and what their numbers add to it is known.
        found = found.withColumn("head_count", count_column(context_header(F.col("title"), F.col("breadcrumb"), F.col("url"))))
    rows = found.select(*[c for c in found.columns if c != "contents"], F.posexplode("contents").alias("nth", "content"))
    chunk_idx = F.col("first") + F.col("nth")
    number = F.when(F.col("parts") > 0, F.concat_ws("/", (F.col("nth") + 1).cast("string"), F.col("parts").cast("string")))
    suffix = F.when(number.isNotNull(), F.concat(F.lit(f" ({PART} "), number, F.lit(")"))).otherwise(F.lit(""))
    crumb = F.when(F.col("breadcrumb") != "", F.concat("breadcrumb", suffix)).otherwise(F.trim(suffix))
    full = with_context(F.col("title"), crumb, F.col("url"), F.col("content"))
    # "(part i/n)" is two words, and "| section:" two more where the header has no breadcrumb without it.
    more = F.when(F.col("parts") == 0, 0).when(F.col("breadcrumb") != "", 2).otherwise(4)
    token_count = F.col("head_count") + more + count_column(F.col("content")) if adds_up else count_column(full)
    return rows.select(
        chunk_id(F.col("article_type"), F.col("article_slug"), chunk_idx).alias("id"),
        F.col("article_type").alias("type"),
        "article_slug",
        F.col("title").alias("article_title"),
        F.col("url").alias("article_url"),
        F.col("breadcrumb").alias("section_path"),
        full.alias("text"),
        token_count.alias("token_count"),
        number.alias("split_part"),
        chunk_idx.alias("chunk_idx"),
        "section",
        "content",
    )


def chunk_articles(articles: DataFrame, max_tokens: int | None = MAX_TOKENS, fail: bool = True, **counting) -> DataFrame:
    """Chunks of every article; one that is above the cap after splitting fails the job.

    With ``fail=False`` such chunks are given as they are; ``within_cap`` takes their
    articles out.
    """
    chunks = article_chunks(articles, max_tokens, **counting).drop("section", "content")
    if max_tokens is None or not fail:
        return chunks
    message = F.concat(F.lit("chunk above the token cap in "), F.col("type"), F.lit("/"), F.col("article_slug"))
    checked = F.when(F.col("token_count") > max_tokens, F.raise_error(message)).otherwise(F.col("token_count"))
    return chunks.withColumn("token_count", checked)


def over_cap(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``type, article_slug, n_over, most_tokens`` of the articles with chunks above the cap."""
    over = chunks.where(F.col("token_count") > max_tokens)
    return over.groupBy("type", "article_slug").agg(F.count(F.lit(1)).alias("n_over"), F.max("token_count").alias("most_tokens"))


def within_cap(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The chunks of articles that hold the cap, and the other articles (``over_cap``)."""
    failed = over_cap(chunks, max_tokens)
    return chunks.join(failed.select("type", "article_slug"), ["type", "article_slug"], "left_anti").select(*chunks.columns), failed
