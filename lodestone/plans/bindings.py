"""The library's inputs as bound to the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import BOILERPLATE, stripped
from lodestone.operators.chunking import chunk_articles

SITE = "https://articles.example.org"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, cut: int = 0) -> DataFrame:
    """``documents`` in the article format: every fourth line becomes a header.

    Type is the language, slug the id. Marks that mean something in markdown and blank
    lines are taken out first, so that SQL can say the same. The last ``cut`` lines go.
    """
    text = F.coalesce("text", F.lit(""))
    plain = F.when(F.rlike(text, F.lit("[#`~\r]")), F.translate(text, "#`~\r", "")).otherwise(text)
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(
        F.slice(lines, F.lit(1), F.greatest(F.size(lines) - cut, F.lit(0))),
        lambda x, i: F.when(i % 8 == 3, F.concat(F.lit("## "), x)).when(i % 8 == 7, F.concat(F.lit("### "), x)).otherwise(x),
    )
    slug = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit(f"# SOURCE_URL: {SITE}/"), "lang", F.lit("/"), slug, F.lit("/\n\n# Doc "), slug, F.lit(f"\n\n{BOILERPLATE}\n\n")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("article_type"), slug.alias("article_slug"), F.concat(head, F.array_join(marked, "\n")).alias("text")
    )


def changed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later delivery: every tenth article without its last three lines."""
    return articles(spark, sf_dir, cut=3).where(F.col("article_slug").cast("long") % 10 == 0)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all articles, sections whole (no token cap)."""
    return chunk_articles(articles(spark, sf_dir), max_tokens=None)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per benchmark item: its first eight words."""
    words = F.split(stripped(F.col("text")), r"\s+")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.array_join(F.slice(words, 1, 8), " ").alias("question")
    )


def qa_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, type, article_slug, context`` per benchmark item: its whole text; no type without an article."""
    types = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("type"))
    return table(spark, sf_dir, "benchmark").join(types, "item_id", "left").select(
        F.col("item_id").alias("case_id"), "type", F.col("item_id").cast("string").alias("article_slug"), F.col("text").alias("context")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a chat log: markers and sources on answers, times by arithmetic."""
    base = table(spark, sf_dir, "conversations")
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)).cast("int")
    answer = F.col("role") == "assistant"
    source = lambda k: F.struct(
        F.lit(k).alias("n"), F.concat(F.lit("Doc "), F.col("conv_id").cast("string")).alias("title")
    )
    sources = F.when(n == 2, F.array(source(1), source(2))).when(n == 1, F.array(source(1)))
    return base.select(
        F.col("conv_id"),
        F.col("turn"),
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"),
        "role",
        F.when(answer, F.concat("text", F.lit(" [1] and [2][9]"))).otherwise(F.col("text")).alias("text"),
        F.when(answer, sources).alias("sources"),
        F.when(answer, n).otherwise(F.lit(0)).alias("source_count"),
        (F.lit(1_700_000_000_000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 1000).alias("created_at"),
    )


def _sections_sql(prefix: str, cut: int, where: str) -> str:
    """CTEs ``<prefix>articles, sections, passages, chunks``; the k-th section begins at line 4k."""
    return rf"""
{prefix}lines AS (
  SELECT lang AS article_type, doc_id::VARCHAR AS article_slug, list_slice(ls, 1, greatest(len(ls) - {cut}, 0)) AS ls FROM (
    SELECT lang, doc_id, list_filter(list_transform(string_split(translate(coalesce(text, ''), '#`~' || chr(13), ''), chr(10)),
      lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents WHERE {where})
),
{prefix}articles AS (
  SELECT article_type, article_slug, ls, '# SOURCE_URL: {SITE}/' || article_type || '/' || article_slug || '/' || chr(10) || chr(10)
    || '# Doc ' || article_slug || chr(10) || chr(10) || '{BOILERPLATE}' || chr(10) || chr(10)
    || array_to_string(list_transform(ls, lambda x, i: CASE WHEN i % 8 = 4 THEN '## ' || x WHEN i % 8 = 0 THEN '### ' || x ELSE x END), chr(10)) AS text
  FROM {prefix}lines
),
{prefix}parts AS (
  SELECT article_type, article_slug, ls, unnest(range(0, len(ls) // 4 + 1)) AS k FROM {prefix}articles
),
{prefix}sections AS (
  SELECT article_type, article_slug, '{SITE}/' || article_type || '/' || article_slug || '/' AS url, 'Doc ' || article_slug AS title, k AS nth,
    CASE WHEN k = 0 THEN '' WHEN k % 2 = 1 THEN ls[4 * k] ELSE ls[4 * k - 4] || ' > ' || ls[4 * k] END AS breadcrumb,
    CASE WHEN k = 0 THEN '' WHEN k % 2 = 1 THEN '## ' || ls[4 * k] || chr(10) ELSE '### ' || ls[4 * k] || chr(10) END
      || array_to_string(ls[4 * k + 1 : least(4 * k + 3, len(ls))], chr(10)) AS content
  FROM {prefix}parts WHERE len(ls) > 4 * k
),
{prefix}passages AS (
  SELECT article_type AS type, article_slug, title AS article_title, url AS article_url, breadcrumb AS section_path, content,
    '[Chủ đề: ' || title || CASE WHEN breadcrumb <> '' THEN ' | Mục: ' || breadcrumb ELSE '' END || ' | Nguồn: ' || url || ']'
      || chr(10) || chr(10) || content AS text,
    (row_number() OVER (PARTITION BY article_type, article_slug ORDER BY nth) - 1)::INT AS chunk_idx,
    article_type || ':' || article_slug || ':' || (row_number() OVER (PARTITION BY article_type, article_slug ORDER BY nth) - 1) AS name
  FROM {prefix}sections
),
{prefix}chunks AS (
  SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
    len(regexp_extract_all(text, '\S+'))::INT AS token_count
  FROM (SELECT *, sha1(unhex('f47b6a3e3f0e4b8a9c2e2f8e6a1d7c50') || name::BLOB) AS h FROM {prefix}passages)
)"""


INPUTS_SQL = (
    _sections_sql("", 0, "true")
    + ","
    + _sections_sql("new_", 3, "doc_id % 10 = 0")
    + r""",
questions AS (
  SELECT item_id AS question_id, array_to_string((regexp_split_to_array(trim(text, chr(10) || ' '), '\s+'))[1:8], ' ') AS question FROM benchmark
),
messages AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS msg_id, role,
    CASE WHEN role = 'assistant' THEN text || ' [1] and [2][9]' ELSE text END AS text,
    CASE WHEN role = 'assistant' THEN (conv_id + turn) % 3 ELSE 0 END::INT AS source_count,
    1700000000000 + conv_id * 3600000 + turn * 1000 AS created_at
  FROM conversations
)"""
)


def sql(tail: str) -> str:
    """A query over the bound inputs (CTEs articles, sections, chunks, the same as new_..., questions, messages)."""
    return f"WITH {INPUTS_SQL.strip()}{',' if tail.lstrip().upper().startswith('CTE') else ''}\n{tail.lstrip().removeprefix('CTE')}"


__all__ = ["articles", "changed_articles", "messages", "passages", "qa_contexts", "questions", "sql", "table"]
