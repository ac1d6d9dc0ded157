"""Queries: containment, profile, invariants and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import BOILERPLATE
from lodestone.operators import bm25, evaluate, search
from lodestone.operators.chunking import MAX_TOKENS, section_rows
from lodestone.plans.bindings import articles, changed_articles, passages, qa_contexts, sql
from lodestone.plans.search_queries import HYBRID_SQL, sparse_index, with_vectors
from lodestone.sources.tables import materialised

BASELINES = {"en": 0.6, "de": 0.99}


def containment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per article: its sixth line. Every third is spoilt, every seventh names no article."""
    lines = F.split(F.element_at(F.split("text", f"{BOILERPLATE}\n\n"), 2), "\n")
    n = F.col("article_slug").cast("long")
    context = F.when(n % 3 == 0, F.concat(F.lit("zzz "), F.get(lines, F.lit(5)))).otherwise(F.get(lines, F.lit(5)))
    return articles(spark, sf_dir).select(
        n.alias("case_id"), F.col("article_type").alias("type"),
        F.when(n % 7 == 0, "none").otherwise(F.col("article_slug")).alias("article_slug"), context.alias("context"),
    )


def context_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.context_containment(containment_cases(spark, sf_dir), passages(spark, sf_dir))


def containment_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.containment_gate(context_containment(spark, sf_dir), BASELINES)


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = section_rows(articles(spark, sf_dir)).select(F.col("article_type").alias("type"), "article_slug", "content")
    over = passages(spark, sf_dir).select("type", (F.col("token_count") > MAX_TOKENS).alias("over"))
    profile = evaluate.corpus_profile(rows, over)
    return profile.select("type", "files", *[F.round(c, 6).alias(c) for c in ("sections_per_file", "median_chars", "p90_chars", "split_rate")])


def corpus_profile_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile after a delivery, from sketches of which only touched buckets were made anew; are its ranks right to 2 %?"""
    def rows(source: DataFrame) -> DataFrame:
        return section_rows(source).select(F.col("article_type").alias("type"), "article_slug", "content")

    before, new = articles(spark, sf_dir), changed_articles(spark, sf_dir)
    touched = new.select(F.col("article_type").alias("type"), "article_slug")
    now = materialised(rows(before.join(touched, "article_slug", "left_anti").unionByName(new)), "sections")
    sketches = evaluate.refreshed_sketches(materialised(evaluate.profile_sketches(rows(before)), "sketches"), touched, now)
    profile = materialised(evaluate.sketched_profile(sketches), "profile")
    sizes = now.select("type", F.length("content").alias("size")).join(F.broadcast(profile.select("type", "median_chars", "p90_chars")), "type")
    near = lambda c, q: (F.avg((F.col("size") < F.col(c)).cast("int")) <= q + 0.02) & (F.avg((F.col("size") <= F.col(c)).cast("int")) >= q - 0.02)
    right = sizes.groupBy("type").agg(near("median_chars", 0.5).alias("median_right"), near("p90_chars", 0.9).alias("p90_right"))
    return profile.join(right, "type").select("type", "files", F.round("sections_per_file", 6).alias("sections_per_file"), "median_right", "p90_right")


def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.chunk_invariants(passages(spark, sf_dir), MAX_TOKENS)


def max_segmented_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.longest_chunk(passages(spark, sf_dir))


def sample_cases_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sample_per_type(containment_cases(spark, sf_dir), 30).select("case_id", "type")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the right article and the right context for every question in three modes."""
    chunks, asked = with_vectors(spark, sf_dir)
    postings, stats = sparse_index(chunks)
    # Read several times below, so stored: a search scans the whole index.
    sparse = materialised(bm25.sparse_topk(asked, postings, stats, k=search.CANDIDATES), "sparse-candidates")
    dense = materialised(search.dense_topk(asked, chunks, k=search.CANDIDATES), "dense-candidates")
    parts = {"dense": dense.where("rank <= 5"), "sparse": sparse.where("rank <= 5"), "hybrid": search.hybrid_search(dense, sparse)}
    ranked = None
    for mode, part in parts.items():
        rows = part.select(F.col("question_id").alias("case_id"), "chunk_id", "rank", F.lit(mode).alias("mode"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    payload = chunks.select(F.col("id").alias("chunk_id"), F.col("type").alias("hit_type"), F.col("article_slug").alias("hit_slug"), "text")
    # Both are read more than once in what follows.
    hits = materialised(ranked.join(payload, "chunk_id"), "hits")
    return materialised(evaluate.first_hits(qa_contexts(spark, sf_dir), hits), "records")


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.eval_summary(records(spark, sf_dir))


def smoke_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.smoke_rates(records(spark, sf_dir))


QUERIES = {
    "context_containment": context_containment,
    "containment_rate_gate": containment_rate_gate,
    "corpus_profile": corpus_profile,
    "corpus_profile_sketched": corpus_profile_sketched,
    "chunk_invariants": chunk_invariants,
    "max_segmented_tokens": max_segmented_tokens,
    "sample_cases_per_type": sample_cases_per_type,
    "first_hits": records,
    "eval_summary": eval_summary,
    "smoke_hit_rates": smoke_hit_rates,
}

_NORM = r"trim(regexp_replace(regexp_replace({}, '\*+', '', 'g'), '\s+', ' ', 'g'))"

CASES_SQL = rf"""CTE
cases AS (SELECT article_slug::BIGINT AS case_id, article_type AS type, CASE WHEN article_slug::BIGINT % 7 = 0 THEN 'none' ELSE article_slug END AS article_slug,
  CASE WHEN article_slug::BIGINT % 3 = 0 THEN 'zzz ' || ls[6] ELSE ls[6] END AS context FROM articles),
hit AS (SELECT case_id, c.type, bool_or(coalesce(contains({_NORM.format('p.text')}, {_NORM.format('c.context')}), false)) AS hit
  FROM cases c JOIN chunks p USING (type, article_slug) GROUP BY case_id, c.type)"""

RECORDS_SQL = HYBRID_SQL + rf""",
ranked AS (SELECT 'dense' AS mode, question_id, chunk_id, rank FROM dense WHERE rank <= 5 UNION ALL
  SELECT 'sparse', question_id, chunk_id, rank FROM sparse WHERE rank <= 5 UNION ALL SELECT 'hybrid', question_id, chunk_id, rank FROM fused WHERE rank <= 5),
qcases AS (SELECT item_id AS question_id, lang AS type, b.text AS context FROM benchmark b LEFT JOIN documents ON doc_id = item_id),
records AS (SELECT q.type, m.mode, q.question_id AS case_id,
    min(r.rank) FILTER (c.type = q.type AND c.article_slug = q.question_id::VARCHAR)::INT AS article_rank,
    min(r.rank) FILTER (contains({_NORM.format('c.text')}, {_NORM.format('q.context')}))::INT AS chunk_rank
  FROM qcases q CROSS JOIN (SELECT DISTINCT mode FROM ranked) m LEFT JOIN ranked r ON r.question_id = q.question_id AND r.mode = m.mode
  LEFT JOIN chunks c ON c.id = r.chunk_id GROUP BY ALL)"""

SQL = {
    "context_containment": sql(CASES_SQL + " SELECT * FROM hit"),
    "containment_rate_gate": sql(
        CASES_SQL
        + """ SELECT type, count(*) FILTER (hit) AS hits, count(*) AS total, round(avg(hit::INT), 6) AS rate,
        coalesce(avg(hit::INT) >= CASE type WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.99 END - 0.03, true) AS ok FROM hit GROUP BY type"""
    ),
    "corpus_profile": sql(
        """SELECT type, count(DISTINCT article_slug) AS files, round(count(*) / count(DISTINCT article_slug), 6) AS sections_per_file,
        round(quantile_cont(length(content), 0.5), 6) AS median_chars, round(quantile_cont(length(content), 0.9), 6) AS p90_chars,
        round(avg((token_count > 400)::INT), 6) AS split_rate FROM chunks GROUP BY type"""
    ),
    "corpus_profile_sketched": sql(
        """SELECT type, count(DISTINCT article_slug) AS files, round(count(*) / count(DISTINCT article_slug), 6) AS sections_per_file,
        true AS median_right, true AS p90_right FROM (SELECT type, article_slug FROM chunks WHERE article_slug::BIGINT % 10 <> 0
        UNION ALL SELECT type, article_slug FROM new_chunks) GROUP BY type"""
    ),
    "chunk_invariants": sql(
        r"""SELECT count(*) FILTER (token_count > 400) AS over_cap, count(*) FILTER (regexp_replace(content, '\s+', '', 'g') = '') AS empty_body,
        count(*) - count(DISTINCT id) AS duplicate_ids FROM chunks"""
    ),
    "max_segmented_tokens": sql("SELECT token_count AS max_tokens, id FROM chunks ORDER BY token_count DESC, id LIMIT 1"),
    "sample_cases_per_type": sql(
        CASES_SQL + " SELECT case_id, type FROM cases QUALIFY row_number() OVER (PARTITION BY type ORDER BY md5('42:' || case_id), case_id) <= 30"
    ),
    "first_hits": sql(RECORDS_SQL + " SELECT * FROM records"),
    "eval_summary": sql(
        RECORDS_SQL
        + """ SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, mode, count(*) AS n, round(avg(coalesce(article_rank <= 5, false)::INT), 6) AS article_at_k,
        round(avg(coalesce(chunk_rank = 1, false)::INT), 6) AS chunk_at_1, round(avg(coalesce(chunk_rank <= 5, false)::INT), 6) AS chunk_at_k,
        round(avg(coalesce(1.0 / chunk_rank, 0)), 6) AS mrr FROM records GROUP BY GROUPING SETS ((type, mode), (mode))"""
    ),
    "smoke_hit_rates": sql(
        RECORDS_SQL
        + """ SELECT type, mode, round(avg(coalesce(article_rank <= 5, false)::INT), 6) AS article_rate, round(avg(coalesce(chunk_rank <= 5, false)::INT), 6) AS chunk_rate
        FROM records GROUP BY type, mode"""
    ),
}
