"""Queries: articles, sections, chunks and the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.chunking import MAX_TOKENS, article_chunks, chunk_articles, parsed_articles, section_rows, within_cap
from lodestone.plans.bindings import articles, messages, passages, sql, table
from lodestone.sources.tables import materialised


def parse_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_articles(articles(spark, sf_dir))


def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_rows(articles(spark, sf_dir)).select("article_type", "article_slug", "breadcrumb", "content")


def inject_context_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = section_rows(articles(spark, sf_dir))
    text = T.with_context(F.col("title"), F.col("breadcrumb"), F.col("url"), F.col("content"))
    return rows.select("article_type", "article_slug", "breadcrumb", text.alias("text"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("id", "type", "article_slug", "chunk_idx")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("id", "token_count")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with whole sections."""
    return passages(spark, sf_dir)


def guarded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section after splitting at the cap of 400 tokens.

    ``split``: whether it was above the cap; ``body``: a digest of its parts' text without
    white space; ``numbered``: whether its parts are 1/n to n/n; ``fits``: whether all hold the cap.
    """
    parts = article_chunks(articles(spark, sf_dir))
    dense = F.regexp_replace("content", r"[\x20\x09-\x0D]+", "")
    grouped = parts.groupBy("type", "article_slug", "section").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", dense.alias("dense"), "split_part"))).alias("ps"),
        F.max("token_count").alias("most"),
    )
    n = F.size("ps")
    expected = F.transform("ps", lambda p, k: F.coalesce(p["split_part"] == F.concat_ws("/", (k + 1).cast("string"), n.cast("string")), F.lit(False)))
    split = F.col("ps")[0]["split_part"].isNotNull()
    return grouped.select(
        "type", "article_slug", "section", split.alias("split"),
        F.md5(F.array_join(F.transform("ps", lambda p: p["dense"]), "")).alias("body"),
        (~split | F.forall(expected, lambda x: x)).alias("numbered"),
        (F.col("most") <= MAX_TOKENS).alias("fits"),
    )


def capped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose chunks all hold the cap, with their number of whole sections, and the failed ones."""
    counted = chunk_articles(articles(spark, sf_dir), fail=False).select("type", "article_slug", "token_count", "split_part")
    good, failed = within_cap(materialised(counted, "capped"))
    whole = good.groupBy("type", "article_slug").agg(F.count_if(F.col("split_part").isNull()).alias("whole_sections"))
    return whole.withColumn("ok", F.lit(True)).unionByName(
        failed.select("type", "article_slug", F.lit(None).cast("long").alias("whole_sections"), F.lit(False).alias("ok"))
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


def term_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms with their 32-bit index."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    return words.select("term", T.term_index(F.col("term")).alias("term_index"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalised(F.col("text")).alias("norm"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", T.slug_from_url(F.col("url")).alias("slug"), T.is_http_url(F.col("url")).alias("is_http")
    )


def passage_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return passages(spark, sf_dir).select("id", T.chunk_body(text).alias("body"), T.passage_of(text).alias("passage"))


def split_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = messages(spark, sf_dir).where("role = 'assistant'").select(
        "msg_id", F.posexplode(T.split_citations(F.col("text"), F.col("source_count"))).alias("pos", "part")
    )
    return parts.where("part.kind = 'cite'").groupBy("msg_id").agg(
        F.count(F.lit(1)).alias("n_cites"), F.array_join(F.array_sort(F.collect_set("part.n")), ",").alias("cited")
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("msg_id", T.title_of(F.col("text")).alias("title"))


def validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages as questions; rejected ones have a null question."""
    asked = messages(spark, sf_dir).where("role = 'user'")
    question = T.question_or_null(F.col("text"))
    return asked.select("msg_id", question.alias("question"), question.isNotNull().alias("accepted"))


def round_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") / F.lit(7.0))
    return table(spark, sf_dir, "documents").select("doc_id", T.shown_score(score).alias("shown"))


QUERIES = {
    "parse_article": parse_article,
    "split_sections": split_sections,
    "inject_context_header": inject_context_header,
    "chunk_id": chunk_ids,
    "token_count": token_counts,
    "chunk_articles": chunks,
    "guard_rail_split": guarded_sections,
    "within_cap": capped_chunks,
    "terms": terms,
    "term_index": term_indices,
    "normalize_text": normalize_text,
    "slug_from_url": url_parts,
    "passage_of": passage_bodies,
    "split_citations": split_citations,
    "title_of": titles,
    "validate_questions": validate_questions,
    "round_score": round_score,
}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

#: A part has the header, two words of its number and one of its own at least.
CAPPED_SQL = r"""CTE
capped AS (SELECT *, token_count > 400 AS split, len(regexp_extract_all(substr(text, 1, instr(text, ']' || chr(10) || chr(10))), '\S+')) AS head FROM chunks),
fitting AS (SELECT *, NOT split OR head + 3 <= 400 AS fits FROM capped)"""

#: The table of CRC-32 by its rule, and each term's bytes folded through it.
CRC_SQL = r"""WITH RECURSIVE
steps(b, n, c) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL
  SELECT b, n + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+')) AS term FROM documents),
folded AS (SELECT term, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(term) + 1),
  lambda i: ('0x' || substr(hex(term), 2 * i - 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])) AS a FROM words, crc)"""

SQL = {
    "guard_rail_split": sql(
        CAPPED_SQL
        + r""" SELECT type, article_slug, chunk_idx AS section, split, md5(regexp_replace(content, '[\x20\x09-\x0D]+', '', 'g')) AS body,
        true AS numbered, fits FROM fitting"""
    ),
    "within_cap": sql(
        CAPPED_SQL
        + """ SELECT type, article_slug, CASE WHEN bool_and(fits) THEN count(*) FILTER (NOT split) END AS whole_sections, bool_and(fits) AS ok
        FROM fitting GROUP BY type, article_slug"""
    ),
    "term_index": CRC_SQL + " SELECT term, xor(a, 4294967295)::BIGINT AS term_index FROM folded",
    "parse_article": sql(
        r"SELECT article_type, article_slug, 'https://articles.example.org/' || article_type || '/' || article_slug || '/' AS url, "
        r"'Doc ' || article_slug AS title, regexp_replace(substr(text, instr(text, 'Nội dung bài viết') + 17), '^\s+|\s+$', '', 'g') AS body FROM articles"
    ),
    "split_sections": sql("SELECT article_type, article_slug, breadcrumb, content FROM sections"),
    "inject_context_header": sql("SELECT type AS article_type, article_slug, section_path AS breadcrumb, text FROM chunks"),
    "chunk_id": sql("SELECT id, type, article_slug, chunk_idx FROM chunks"),
    "token_count": sql("SELECT id, token_count FROM chunks"),
    "chunk_articles": sql(
        "SELECT id, type, article_slug, article_title, article_url, section_path, text, token_count, NULL::VARCHAR AS split_part, chunk_idx FROM chunks"
    ),
    "terms": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+'), ' ') AS terms FROM documents",
    "normalize_text": r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\*+', '', 'g'), '\s+', ' ', 'g')) AS norm FROM documents",
    "slug_from_url": r"SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS slug, regexp_matches(url, '^https?://') AS is_http FROM pages",
    "passage_of": sql(
        r"SELECT id, substr(text, instr(text, chr(10) || chr(10)) + 2) AS body, CASE WHEN length(p) > 300 THEN substr(p, 1, 300) || '…' ELSE p END AS passage "
        r"FROM (SELECT id, text, regexp_replace(regexp_replace(text, '^\[[^\]]*\]\s*', ''), '^\s+|\s+$', '', 'g') AS p FROM chunks)"
    ),
    "split_citations": sql(
        r"SELECT msg_id, count(*) AS n_cites, array_to_string(list_sort(list_distinct(list(n))), ',') AS cited FROM (SELECT msg_id, source_count, "
        r"unnest(regexp_extract_all(text, '\[(\d{1,9})\]', 1))::INT AS n FROM messages WHERE role = 'assistant') WHERE n BETWEEN 1 AND source_count GROUP BY msg_id"
    ),
    "title_of": sql(
        r"SELECT msg_id, CASE WHEN length(p) > 40 THEN substr(p, 1, 40) || '…' ELSE p END AS title FROM "
        r"(SELECT msg_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM messages)"
    ),
    "validate_questions": sql(
        r"SELECT msg_id, CASE WHEN length(p) BETWEEN 1 AND 1000 THEN p END AS question, length(p) BETWEEN 1 AND 1000 AS accepted FROM "
        r"(SELECT msg_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM messages WHERE role = 'user')"
    ),
    "round_score": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN format('{:.2f}', n_chars / 7.0) END AS shown FROM documents",
}
