"""Queries: BM25, dense, hybrid search and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import query_vector, terms, word_count
from lodestone.operators import blockmax, bm25, lexicon, search
from lodestone.operators import vectors as vectors_by_list
from lodestone.operators.embed import with_embed_input
from lodestone.plans.bindings import passages, questions, sql, table
from lodestone.sources.tables import materialised, scratch


def sparse_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored postings (packed) and statistics of chunks."""
    postings = materialised(bm25.packed_postings(chunks), "postings")
    return postings, materialised(bm25.stats_of_postings(chunks, postings), "stats")


def _postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sparse_index(passages(spark, sf_dir))


def bm25_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = bm25.corpus_stats(passages(spark, sf_dir))
    return stats.select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


def bm25_encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of every chunk's sparse vector."""
    postings, stats = _postings(spark, sf_dir)
    # Weights are an array per chunk: nothing is shuffled. A chunk without terms has no vector.
    weights = postings.where(F.size("entries") > 0).join(F.broadcast(stats.select("avgdl")), F.lit(True)).select("chunk_id", bm25.entry_weights(F.col("avgdl")).alias("w"))
    return weights.select(
        "chunk_id", F.size("w").cast("long").alias("n_terms"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("w"), 9).alias("top")
    )


def encode_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = questions(spark, sf_dir).select("question_id", query_vector(terms(F.col("question"))).alias("v"))
    return vectors.select("question_id", F.size("v").cast("long").alias("n_terms"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x["weight"]).alias("total"))


def document_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = materialised(bm25.packed_postings(passages(spark, sf_dir), hashed=False), "postings")
    idf = bm25.inverse_frequencies(postings, bm25.stats_of_postings(postings, postings))
    return idf.groupBy("n").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("idf"), 9).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the five best chunks for every question by BM25."""
    postings, stats = _postings(spark, sf_dir)
    return bm25.sparse_topk(questions(spark, sf_dir), postings, stats).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def bm25_topk_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``bm25_topk``, from stored postings with block maxima: most postings of common terms are not scored."""
    postings, stats = _postings(spark, sf_dir)
    index = blockmax.build_blocks(postings, stats, scratch(spark, "block-postings"))
    return blockmax.blockmax_topk(questions(spark, sf_dir), index).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words that belong together in all chunks, with their weight."""
    pairs = lexicon.collocations(passages(spark, sf_dir))
    return pairs.select("first", "second", "n", F.round("weight", 6).alias("weight"))


def _segmented(spark: SparkSession, sf_dir: str):
    """All chunks with their segmented text, and the segmenter that the chunks' own collocations make."""
    chunks = materialised(passages(spark, sf_dir), "chunks")
    segment = lexicon.segmenter(materialised(lexicon.cut_lexicon(lexicon.collocations(chunks)), "lexicon"))
    return materialised(with_embed_input(chunks, segment), "segmented"), segment


def segmented_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's tokens before and after segmentation."""
    chunks, _ = _segmented(spark, sf_dir)
    return chunks.select("id", "token_count", word_count(F.col("embed_input")).alias("segmented_tokens"))


def segmented_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks for every question by BM25, both segmented alike."""
    chunks, segment = _segmented(spark, sf_dir)
    postings = materialised(bm25.packed_postings(chunks, "embed_input"), "postings")
    stats = materialised(bm25.stats_of_postings(chunks, postings), "stats")
    asked = questions(spark, sf_dir).select("question_id", segment(F.col("question")).alias("question"))
    return bm25.sparse_topk(asked, postings, stats).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every twentieth vector, against all."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "question_id")
    return search.dense_topk(asked, vectors).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _vector_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, vectors_by_list.VectorLists]:
    """Every twentieth vector as a question, and all vectors in inverted lists."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return vectors.where("id % 20 = 0").withColumnRenamed("id", "question_id"), vectors_by_list.build_lists(vectors, scratch(spark, "vector-lists"))


def dense_topk_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``dense_topk``, exactly, from inverted lists: bounds tell which lists and rows are scanned."""
    found = vectors_by_list.search_lists(*_vector_lists(spark, sf_dir), exact=True)
    return found.select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def dense_topk_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors in the lists nearest to each question, at a recall that the fit has measured on its sample."""
    return vectors_by_list.search_lists(*_vector_lists(spark, sf_dir)).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and questions, each with the vector whose id is its number modulo the table's size."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("dense"))
    n = max(1, vectors.count())
    numbered = passages(spark, sf_dir).withColumn("v", F.col("article_slug").cast("long") % n)
    chunks = materialised(numbered.join(vectors, "v"), "chunks")
    asked = questions(spark, sf_dir).withColumn("v", F.col("question_id") % n).join(vectors, "v")
    return chunks, asked


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    chunks, asked = with_vectors(spark, sf_dir)
    postings, stats = sparse_index(chunks)
    sparse = materialised(bm25.sparse_topk(asked, postings, stats, k=search.CANDIDATES), "sparse-candidates")
    return chunks, asked, materialised(search.dense_topk(asked, chunks, k=search.CANDIDATES), "dense-candidates"), sparse


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, dense, sparse = _candidates(spark, sf_dir)
    return search.hybrid_search(dense, sparse).select("question_id", "rank", "chunk_id", F.round("fused", 9).alias("fused"))


def fuse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both candidate lists as one, with the list they came from."""
    _, _, dense, sparse = _candidates(spark, sf_dir)
    return dense.select("question_id", "rank", "chunk_id", F.lit("dense").alias("mode")).unionByName(
        sparse.select("question_id", "rank", "chunk_id", F.lit("sparse").alias("mode"))
    )


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates by an injected scorer (here text length; it fails for every fifth question)."""
    chunks, asked, dense, sparse = _candidates(spark, sf_dir)
    fused = search.hybrid_search(dense, sparse, rerank=True)
    full = fused.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id").join(asked.select("question_id", "question"), "question_id")
    scorer = F.when(F.col("question_id") % 5 != 0, F.length("text").cast("double"))
    return search.rerank(full, scorer).select("question_id", "n", "chunk_id", "score")


QUERIES = {
    "bm25_fit": bm25_fit,
    "bm25_encode_docs": bm25_encode_docs,
    "encode_queries": encode_queries,
    "document_frequency_idf": document_frequency_idf,
    "bm25_topk": bm25_topk,
    "bm25_topk_blockmax": bm25_topk_blockmax,
    "collocations": collocations,
    "segmented_terms": segmented_terms,
    "segmented_bm25_topk": segmented_bm25_topk,
    "dense_topk": dense_topk,
    "dense_topk_by_lists": dense_topk_by_lists,
    "dense_topk_probed": dense_topk_probed,
    "hybrid_search": hybrid_search,
    "fuse_candidates": fuse_candidates,
    "rerank": rerank,
}

POSTINGS_SQL = r"""CTE
words AS (SELECT id AS chunk_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') AS ws FROM chunks),
stats AS (SELECT count(*) AS n_chunks, sum(len(ws)) / count(*) AS avgdl FROM words),
postings AS (SELECT chunk_id, term, dl, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS term FROM words) GROUP BY ALL),
weighted AS (SELECT chunk_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats))) AS weight FROM postings),
idf AS (SELECT term, n, ln(1 + (n_chunks - n + 0.5) / (n + 0.5)) AS idf FROM (SELECT term, count(*) AS n FROM postings GROUP BY term), stats),
asked AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(nfc_normalize(question)), '[\p{L}\p{N}_]+')) AS term FROM questions),
sparse_all AS (SELECT question_id, chunk_id, round(sum(weight * idf), 9) AS score FROM asked JOIN idf USING (term) JOIN weighted USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM sparse_all)"""

HYBRID_SQL = POSTINGS_SQL + """,
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v, count(*) OVER () AS n FROM embeddings),
chunk_vectors AS (SELECT c.id, v FROM chunks c JOIN vectors ON vec_id = c.article_slug::BIGINT % n),
question_vectors AS (SELECT question_id, v FROM questions JOIN vectors ON vec_id = question_id % n),
dense AS (SELECT question_id, c.id AS chunk_id, row_number() OVER (PARTITION BY question_id
  ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.id) AS rank FROM question_vectors q, chunk_vectors c),
candidates AS (SELECT question_id, chunk_id, rank, 'dense' AS mode FROM dense WHERE rank <= 20
  UNION ALL SELECT question_id, chunk_id, rank, 'sparse' FROM sparse WHERE rank <= 20),
fused AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT question_id, chunk_id, round(sum(1.0 / (2 + rank - 1)), 12) AS score FROM candidates GROUP BY ALL))"""

SQL = {
    "bm25_fit": sql(POSTINGS_SQL + " SELECT n_chunks, round(avgdl, 6) AS avgdl FROM stats"),
    "bm25_encode_docs": sql(POSTINGS_SQL + " SELECT chunk_id, count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 9) AS top FROM weighted GROUP BY chunk_id"),
    "encode_queries": sql(POSTINGS_SQL + " SELECT question_id, count(*) AS n_terms, count(*)::DOUBLE AS total FROM asked GROUP BY question_id"),
    "document_frequency_idf": sql(POSTINGS_SQL + " SELECT n, count(*) AS n_terms, round(max(idf), 9) AS idf FROM idf GROUP BY n"),
    "bm25_topk": sql(POSTINGS_SQL + " SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM sparse WHERE rank <= 5"),
    "dense_topk": """SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS question_id, d.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score
    FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
    "hybrid_search": sql(HYBRID_SQL + " SELECT question_id, rank, chunk_id, round(score, 9) AS fused FROM fused WHERE rank <= 5"),
    "fuse_candidates": sql(HYBRID_SQL + " SELECT question_id, rank, chunk_id, mode FROM candidates"),
    "rerank": sql(
        HYBRID_SQL
        + """ SELECT question_id, n, chunk_id, score FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id
  ORDER BY score DESC NULLS LAST, rank) AS n FROM (SELECT f.question_id, chunk_id, f.rank, CASE WHEN f.question_id % 5 <> 0 THEN length(text)::DOUBLE END AS score
  FROM fused f JOIN chunks ON id = chunk_id WHERE f.rank <= 20)) WHERE n <= 5"""
    ),
}

SQL["collocations"] = sql(
    r"""CTE
runs AS (SELECT string_split(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?: [\p{L}\p{N}]+)*')), ' ') AS w FROM chunks),
single AS (SELECT unnest(w) AS word, count(*) AS n FROM runs GROUP BY 1),
pairs AS (SELECT w[i] AS first, w[i + 1] AS second, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM runs) GROUP BY ALL HAVING count(*) >= 5),
rated AS (SELECT first, second, p.n, round(ln(p.n::DOUBLE * total / (a.n::DOUBLE * b.n)) / -ln(p.n::DOUBLE / total), 9) AS weight FROM pairs p
  JOIN single a ON a.word = first JOIN single b ON b.word = second, (SELECT sum(n)::DOUBLE AS total FROM single))
SELECT first, second, n, round(weight, 6) AS weight FROM rated WHERE weight >= 0.5"""
)
SQL["bm25_topk_blockmax"] = SQL["bm25_topk"]
SQL["dense_topk_by_lists"] = SQL["dense_topk"]
