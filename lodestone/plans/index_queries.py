"""Queries: storing, replacing and checking the index; incremental ingestion."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import index as ix
from lodestone.operators.build import Built, Recipe, build_index, index_frequencies, index_stats
from lodestone.operators.chunking import chunk_articles
from lodestone.plans.bindings import articles, changed_articles, passages, sql, table
from lodestone.plans.search_queries import POSTINGS_SQL
from lodestone.sources.files import article_names, load_conversations, read_articles, read_qa_cases, save_conversations, write_articles
from lodestone.sources.tables import scratch
from lodestone.streaming.ingest import incremental_ingest, ingest_files, remove_missing

DIMENSION = 2


def _slug() -> Column:
    return F.col("article_slug").cast("long")


def _embedded(chunks: DataFrame, broken: Column) -> DataFrame:
    """Chunks with small vectors; of the wrong size where ``broken``."""
    right = F.array(F.col("chunk_idx").cast("float"), F.lit(1.0).cast("float"))
    return chunks.withColumn("dense", F.when(broken, F.array(F.lit(0.0).cast("float"))).otherwise(right))


def _partly_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all articles; the embedding of every thirtieth article's first chunk fails."""
    return _embedded(passages(spark, sf_dir), (_slug() % 30 == 0) & (F.col("chunk_idx") == 0))


def _faulty_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right index with chunks left out, repeated, renamed, of wrong size and without terms."""
    rows = _embedded(passages(spark, sf_dir), _slug() % 40 == 1).where((_slug() % 50 != 0) | (F.col("chunk_idx") != 0))
    sparse = F.when((_slug() % 60 != 2), F.lit("x"))
    named = rows.select(
        F.when(_slug() % 90 == 3, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"),
        "type", F.when(_slug() % 80 == 4, "moved").otherwise(F.col("article_slug")).alias("article_slug"), "dense", sparse.alias("sparse"),
    )
    return named.unionByName(named.where(F.col("article_slug").try_cast("long") % 70 == 5))


def articles_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as text files, one each, then read back."""
    path = scratch(spark, "articles")
    write_articles(articles(spark, sf_dir), path)
    return read_articles(spark, path)


def qa_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as one CSV folder per type, then read back."""
    path = scratch(spark, "cases")
    cases = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), F.lit("a").alias("answer"),
        F.col("text").alias("context"), F.lit("https://articles.example.org/x/").alias("article_url"), (F.col("item_id") % 2).alias("half"),
    )
    for half, name in ((0, "even"), (1, "odd")):
        cases.where(F.col("half") == half).drop("half").write.csv(f"{path}/{name}.csv", header=True, escape='"', quoteAll=True)
    return read_qa_cases(spark, path).select("article_type", "question", "context")


def write_and_read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "index")
    ix.write_index(_embedded(passages(spark, sf_dir), F.lit(False)), path, placed=True)
    return ix.read_index(spark, path).select("id", "type", "article_slug", "token_count")


def check_index_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.schema_report(_faulty_index(spark, sf_dir), DIMENSION)


def conversations_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories saved as JSON (some damaged), loaded again, without pending messages."""
    message = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text",
        F.lit(None).cast("boolean").alias("error"), (F.col("turn") % 4 == 3).alias("pending"),
    )
    log = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    raw = F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(1).alias("createdAt"), F.transform("ms", lambda m: m["m"]).alias("messages"))))
    damaged = F.when(F.col("conv_id") % 5 == 1, F.substring(raw, 1, 9)).when(F.col("conv_id") % 5 == 2, F.lit("{}")).otherwise(raw)
    saved = log.select("conv_id", save_conversations(load_conversations(damaged)).alias("saved"))
    back = load_conversations(F.col("saved"))
    n = F.aggregate(back, F.lit(0), lambda a, c: a + F.size(c["messages"]))
    return saved.select("conv_id", F.size(back).alias("n_conversations"), n.alias("n_messages"))


def replace_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = changed_articles(spark, sf_dir).select(F.col("article_type").alias("type"), "article_slug")
    new = chunk_articles(changed_articles(spark, sf_dir), None)
    return ix.replace_articles(passages(spark, sf_dir), keys, new).select("id", "type", "article_slug", "chunk_idx", "section_path")


def isolate_failed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.article_status(_partly_failed(spark, sf_dir), DIMENSION)


def good_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ix.isolate_failed(_partly_failed(spark, sf_dir), DIMENSION)
    return good.select("id", "type", "article_slug")


def check_index_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = passages(spark, sf_dir).withColumn("has_terms", F.lit(True))
    return ix.invariant_problems(expected, _faulty_index(spark, sf_dir), DIMENSION)


def missing_unexpected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.id_differences(passages(spark, sf_dir), _faulty_index(spark, sf_dir))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.ingest_report(ix.article_status(_partly_failed(spark, sf_dir), DIMENSION), passages(spark, sf_dir))


def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index_count(passages(spark, sf_dir))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a first build and a streamed delivery of changed articles, taken in twice."""
    base = scratch(spark, "incremental")
    ix.write_index(passages(spark, sf_dir), f"{base}/index", placed=True)
    delivery = changed_articles(spark, sf_dir).withColumn("delivered_at", F.lit(2).cast("long"))
    stale = articles(spark, sf_dir).where(_slug() % 20 == 0).withColumn("delivered_at", F.lit(1).cast("long"))
    delivery.unionByName(stale).write.parquet(f"{base}/incoming")
    for run in ("first", "replay"):
        incremental_ingest(spark, f"{base}/incoming", f"{base}/index", f"{base}/{run}", max_tokens=None)
    return ix.read_index(spark, f"{base}/index").select("id", "type", "article_slug", "chunk_idx", "section_path")


def _connect():
    """A small deterministic embedder; for every thirtieth article's chunks its vectors are too short."""

    def embed(texts, task):
        slugs = [int(t.split("[Chủ đề: Doc ", 1)[1].split(" ", 1)[0]) for t in texts]
        return [[0.0] if slug % 30 == 0 else [float(len(t) % 5), float(task == "document")] for slug, t in zip(slugs, texts)]

    return embed


def _built(spark: SparkSession, sf_dir: str) -> tuple[str, Built]:
    base = scratch(spark, "built")
    return f"{base}/index", build_index(articles(spark, sf_dir), f"{base}/index", _connect, DIMENSION, max_tokens=None, postings_path=f"{base}/postings")


def built_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the whole job: size of each dense vector, and number and total of its sparse weights."""
    path, _ = _built(spark, sf_dir)
    total = F.aggregate("sparse", F.lit(0.0), lambda a, x: a + x["weight"])
    return ix.read_index(spark, path).select(
        "id", "type", "article_slug", F.size("dense").alias("dim"), F.get("dense", F.lit(0)).cast("int").alias("first"),
        F.size("sparse").cast("long").alias("n_terms"), F.round(total, 6).alias("total"),
    )


def built_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's report of one row, with the number of articles that it lists as failed."""
    _, built = _built(spark, sf_dir)
    return built.report.join(built.failures.agg(F.count(F.lit(1)).alias("listed")), F.lit(True))


def _connect_whole():
    """As ``_connect``, but nothing fails."""
    return lambda texts, task: [[float(len(t) % 5), float(task == "document")] for t in texts]


def _changed_index(spark: SparkSession, sf_dir: str, connect=_connect_whole) -> str:
    """A built index after a streamed delivery of changed articles; the path of its store."""
    base = scratch(spark, "changed")
    build_index(articles(spark, sf_dir), f"{base}/index", _connect_whole, DIMENSION, max_tokens=None)
    changed_articles(spark, sf_dir).withColumn("delivered_at", F.lit(2).cast("long")).write.parquet(f"{base}/incoming")
    incremental_ingest(spark, f"{base}/incoming", f"{base}/index", f"{base}/run", recipe=Recipe(connect, DIMENSION, max_tokens=None))
    return f"{base}/index"


def kept_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings after a build and a streamed delivery: terms and length of every chunk."""
    kept = ix.opened(spark, _changed_index(spark, sf_dir)).packed("postings")
    return kept.select("id", F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["tf"]).alias("n_words"), "dl")


def kept_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms (by their CRC-32, as the index knows them) are in n chunks, with the number of chunks and their average length: kept by differences through a delivery."""
    s = ix.opened(spark, _changed_index(spark, sf_dir))
    of_terms = index_frequencies(s).groupBy("n").agg(F.count(F.lit(1)).alias("n_terms"))
    return of_terms.join(index_stats(s), F.lit(True)).select("n", "n_terms", "n_chunks", F.round("avgdl", 6).alias("avgdl"))


def quarantined_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a delivery that could not be embedded, and how many chunks they still have from before."""
    s = ix.opened(spark, _changed_index(spark, sf_dir, _connect))
    kept = s.table(ix.CHUNKS).groupBy("type", "article_slug").agg(F.count(F.lit(1)).alias("n_kept"))
    return s.table("quarantine").join(kept, ["type", "article_slug"], "left").select("type", "article_slug", "reason", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def stream_article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A built index after changed articles came as files and others' files went: chunks with the sizes of both vectors."""
    base = scratch(spark, "article-files")
    recipe = Recipe(_connect_whole, DIMENSION, max_tokens=None)
    build_index(articles(spark, sf_dir), f"{base}/index", _connect_whole, DIMENSION, max_tokens=None)
    write_articles(changed_articles(spark, sf_dir), f"{base}/deliveries/one")
    ingest_files(spark, f"{base}/deliveries/*", f"{base}/index", f"{base}/run", recipe)
    others = articles(spark, sf_dir).where(_slug() % 50 != 1).select("article_type", "article_slug")
    present = others.unionByName(article_names(spark, f"{base}/deliveries/*")).distinct()
    remove_missing(spark, present, f"{base}/index", recipe, now_ms=1 << 52)
    return ix.read_index(spark, f"{base}/index").select(
        "id", "type", "article_slug", "chunk_idx", F.size("dense").alias("dim"), F.size("sparse").cast("long").alias("n_terms")
    )


QUERIES = {
    "build_index": built_index,
    "build_report": built_report,
    "kept_postings": kept_postings,
    "kept_statistics": kept_statistics,
    "quarantined_articles": quarantined_articles,
    "stream_article_files": stream_article_files,
    "read_articles": articles_from_files,
    "read_qa_cases": qa_cases,
    "write_read_index": write_and_read_index,
    "check_index_schema": check_index_schema,
    "load_save_conversations": conversations_io,
    "replace_articles": replace_articles,
    "isolate_failed_articles": isolate_failed_articles,
    "good_chunks": good_chunks,
    "check_index_invariants": check_index_invariants,
    "missing_unexpected_ids": missing_unexpected_ids,
    "ingest_report": ingest_report,
    "index_count": index_count,
    "incremental_ingest": incremental,
}

STATUS_SQL = """CTE
status AS (SELECT type, article_slug, count(*) AS n_chunks,
  count(*) FILTER (NOT (article_slug::BIGINT % 30 = 0 AND chunk_idx = 0)) AS n_valid FROM chunks GROUP BY ALL)"""

FAULTY_SQL = """CTE
f AS (SELECT CASE WHEN s % 90 = 3 THEN 'x' || id ELSE id END AS id, type, CASE WHEN s % 80 = 4 THEN 'moved' ELSE article_slug END AS article_slug,
    CASE WHEN s % 40 = 1 THEN 1 ELSE 2 END AS dim, s % 60 <> 2 AS has_sparse
  FROM (SELECT *, article_slug::BIGINT AS s FROM chunks) WHERE s % 50 <> 0 OR chunk_idx <> 0),
faulty AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE try_cast(article_slug AS BIGINT) % 70 = 5)"""

REPLACED_SQL = """SELECT id, type, article_slug, chunk_idx, section_path FROM chunks WHERE article_slug::BIGINT % 10 <> 0
  UNION ALL SELECT id, type, article_slug, chunk_idx, section_path FROM new_chunks"""

BUILT_SQL = POSTINGS_SQL + """,
terms_of AS (SELECT chunk_id AS id, count(*) AS n_terms, round(sum(weight), 6) AS total FROM weighted GROUP BY chunk_id)"""

#: CTEs ``now`` (chunks after the delivery) and ``now_words`` (their terms).
CHANGED_SQL = r"""CTE
now AS (SELECT id, type, article_slug, chunk_idx, text FROM chunks WHERE article_slug::BIGINT % 10 <> 0
  UNION ALL SELECT id, type, article_slug, chunk_idx, text FROM new_chunks),
now_words AS (SELECT *, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') AS ws FROM now)"""

#: The index knows a term by the CRC-32 of its UTF-8 bytes, so terms that collide are one. Four bits at a time.
_NIBBLES = ", ".join(str(functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), n)) for n in range(16))
CRC_SQL = f""", hexed AS (SELECT DISTINCT term, hex(encode(term)) AS h FROM (SELECT unnest(ws) AS term FROM now_words)),
nibbles AS (SELECT term, list_transform(range(1, length(h) + 1), lambda i: (strpos('0123456789ABCDEF', substr(h, CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END, 1)) - 1)::BIGINT) AS low_first FROM hexed),
crcs AS (SELECT term, xor(list_reduce(low_first, lambda c, x: xor(c >> 4, [{_NIBBLES}][xor(c & 15, x) + 1]), 4294967295::BIGINT), 4294967295) AS term_index FROM nibbles)"""

SQL = {
    "build_index": sql(
        BUILT_SQL
        + """ SELECT id, type, article_slug, 2 AS dim, (length(text) % 5)::INT AS first, n_terms, total
        FROM chunks LEFT JOIN terms_of USING (id) WHERE article_slug::BIGINT % 30 <> 0"""
    ),
    "build_report": sql(
        """SELECT count(DISTINCT article_slug) FILTER (s % 30 <> 0) AS articles_ok, count(DISTINCT article_slug) FILTER (s % 30 = 0) AS articles_failed,
        count(*) FILTER (s % 30 <> 0) AS points_upserted, count(*) AS expected_chunks, count(*) FILTER (s % 30 <> 0) AS index_points,
        count(DISTINCT article_slug) FILTER (s % 30 = 0) AS listed FROM (SELECT *, article_slug::BIGINT AS s FROM chunks)"""
    ),
    "kept_postings": sql(
        r"""SELECT id, len(ws) AS n_words, len(ws) AS dl FROM (SELECT id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') AS ws
        FROM (SELECT id, text FROM chunks WHERE article_slug::BIGINT % 10 <> 0 UNION ALL SELECT id, text FROM new_chunks))"""
    ),
    "kept_statistics": sql(
        CHANGED_SQL
        + CRC_SQL
        + """, terms_of AS (SELECT term_index, count(*) AS n FROM (SELECT DISTINCT id, term_index FROM (SELECT id, unnest(ws) AS term FROM now_words) JOIN crcs USING (term)) GROUP BY term_index)
        SELECT n, count(*) AS n_terms, (SELECT count(*) FROM now) AS n_chunks, (SELECT round(sum(len(ws)) / count(*), 6) FROM now_words) AS avgdl
        FROM terms_of GROUP BY n"""
    ),
    "quarantined_articles": sql(
        """SELECT type, article_slug, 'embedding' AS reason, count(*) AS n_kept FROM chunks
        WHERE article_slug::BIGINT % 30 = 0 AND article_slug IN (SELECT article_slug FROM new_chunks) GROUP BY ALL"""
    ),
    "stream_article_files": sql(
        CHANGED_SQL
        + """ SELECT id, type, article_slug, chunk_idx, 2 AS dim, len(list_distinct(ws)) AS n_terms FROM now_words WHERE article_slug::BIGINT % 50 <> 1"""
    ),
    "read_articles": sql("SELECT article_type, article_slug, text FROM articles"),
    "read_qa_cases": "SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS article_type, 'q' || item_id AS question, text AS context FROM benchmark",
    "write_read_index": sql("SELECT id, type, article_slug, token_count FROM chunks"),
    "check_index_schema": sql(FAULTY_SQL + " SELECT min(dim) AS min_dim, max(dim) AS max_dim, min(dim) = 2 AND max(dim) = 2 AS ok FROM faulty"),
    "load_save_conversations": """SELECT conv_id, CASE WHEN conv_id % 5 IN (1, 2) THEN 0 ELSE 1 END AS n_conversations,
      CASE WHEN conv_id % 5 IN (1, 2) THEN 0 ELSE count(*) FILTER (turn % 4 <> 3) END::INT AS n_messages FROM conversations GROUP BY conv_id""",
    "replace_articles": sql(REPLACED_SQL),
    "isolate_failed_articles": sql(STATUS_SQL + " SELECT *, n_chunks = n_valid AS ok FROM status"),
    "good_chunks": sql(STATUS_SQL + " SELECT id, type, article_slug FROM chunks JOIN status USING (type, article_slug) WHERE n_chunks = n_valid"),
    "check_index_invariants": sql(
        FAULTY_SQL
        + """, b AS (SELECT coalesce(c.id, f.id) AS id, c.id AS want, f.id AS have, dim, has_sparse, c.type AS wt, f.type AS ht, c.article_slug AS ws, f.article_slug AS hs
          FROM chunks c FULL JOIN faulty f ON c.id = f.id)
        SELECT DISTINCT id, 'missing' AS problem FROM b WHERE have IS NULL UNION ALL SELECT DISTINCT id, 'unexpected' FROM b WHERE want IS NULL
        UNION ALL SELECT DISTINCT id, 'dimension' FROM b WHERE have IS NOT NULL AND dim <> 2
        UNION ALL SELECT DISTINCT id, 'sparse' FROM b WHERE want IS NOT NULL AND have IS NOT NULL AND NOT has_sparse
        UNION ALL SELECT DISTINCT id, 'payload' FROM b WHERE want IS NOT NULL AND have IS NOT NULL AND (wt <> ht OR ws <> hs)
        UNION ALL SELECT id, 'duplicate' FROM faulty GROUP BY id HAVING count(*) > 1"""
    ),
    "missing_unexpected_ids": sql(
        FAULTY_SQL
        + """ SELECT id, 'missing' AS side FROM chunks WHERE id NOT IN (SELECT id FROM faulty)
        UNION ALL SELECT DISTINCT id, 'unexpected' FROM faulty WHERE id NOT IN (SELECT id FROM chunks)"""
    ),
    "ingest_report": sql(
        STATUS_SQL
        + """ SELECT count(*) FILTER (n_chunks = n_valid) AS articles_ok, count(*) FILTER (n_chunks <> n_valid) AS articles_failed,
        coalesce(sum(n_chunks) FILTER (n_chunks = n_valid), 0)::BIGINT AS points_upserted, coalesce(sum(n_chunks), 0)::BIGINT AS expected_chunks,
        (SELECT count(*) FROM chunks) AS index_points FROM status"""
    ),
    "index_count": sql("SELECT type, count(*) AS points FROM chunks GROUP BY type"),
    "incremental_ingest": sql(REPLACED_SQL),
}
