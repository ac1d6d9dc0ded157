import re
import time
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import terms
from lodestone.operators import bm25, search


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(texts)], "id string, text string")


def index_of(term):
    return zlib.crc32(term.encode())


def test_bm25_weights_by_hand(spark):
    docs = chunks(spark, "a b", "a c c")
    weights = bm25.weighted_postings(bm25.term_frequencies(docs), bm25.corpus_stats(docs)).collect()
    found = {(r.chunk_id, r.term_index): r.weight for r in weights}
    assert found[("c0", index_of("a"))] == pytest.approx(2.2 / 2.02)
    assert found[("c1", index_of("a"))] == pytest.approx(2.2 / 2.38)
    assert found[("c1", index_of("c"))] == pytest.approx(4.4 / 3.38)


def test_empty_chunks_count_and_empty_corpus_fails(spark):
    assert bm25.corpus_stats(chunks(spark, "a b", "", "!")).first().avgdl == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="corpus with terms"):
        bm25.corpus_stats(chunks(spark, "", "?")).collect()


def test_statistics_from_stored_postings(spark):
    docs = chunks(spark, "a b a", "", "!", "c")
    kept = bm25.stats_of_postings(docs, bm25.term_frequencies(docs)).first()
    assert kept == bm25.corpus_stats(docs).first() and kept.n_chunks == 4
    for empty in (chunks(spark, "", "?"), chunks(spark, "").where("false")):
        with pytest.raises(Exception, match="corpus with terms"):
            bm25.stats_of_postings(empty, bm25.term_frequencies(empty)).collect()


def test_terms_are_composed_only_where_needed(spark):
    texts = ["e\u0301 \u00e9", "plain", "tiếng Việt", "\u1112\u1161\u11ab 한", "\u212b \u03a9", None, "", "中文 đ"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    found = rows.select("k", terms(F.col("text")).alias("w")).orderBy("k").collect()
    for text, row in zip(texts, found, strict=True):
        composed = None if text is None else re.findall(r"\w+", unicodedata.normalize("NFC", text).lower())
        assert row.w == composed


def test_the_test_for_composition_costs_little_beside_the_terms(spark):
    # Few and long words, so that a cost per character shows.
    rows = spark.range(4).repartition(4).select(F.repeat(F.concat(F.lit("đường" * 50 + " "), "id"), 8000).alias("text")).cache()
    assert rows.count() == 4

    def seconds(normalise):
        began = time.perf_counter()
        assert rows.agg(F.max(F.size(terms(F.col("text"), normalise)))).first()[0] == 8001
        return time.perf_counter() - began

    seconds(True), seconds(False)
    assert min(seconds(True) for _ in range(3)) < 2.5 * min(seconds(False) for _ in range(3))


def test_long_texts_of_two_scripts_are_checked_without_recursion(spark):
    rows = spark.range(1).select(F.repeat(F.lit("слово и дело "), 100_000).alias("text"))
    assert rows.select(F.size(terms(F.col("text"))).alias("n")).first().n == 300_000


def test_rare_term_ranks_first(spark):
    docs = chunks(spark, "phổ_biến a", "phổ_biến hiếm", "phổ_biến b", "phổ_biến c")
    questions = spark.createDataFrame([(1, "hiếm phổ_biến"), (2, "!!")], "question_id long, question string")
    top = bm25.sparse_topk(questions, bm25.term_frequencies(docs), bm25.corpus_stats(docs)).orderBy("rank").collect()
    assert top[0].chunk_id == "c1" and {r.question_id for r in top} == {1}
    assert [r.rank for r in top] == [1, 2, 3, 4]


def vectors(spark):
    rows = [("c0", [1.0, 0.0, 0.0]), ("c1", [0.0, 2.0, 0.0]), ("c2", [0.0, 0.0, 3.0]), ("c3", None)]
    return spark.createDataFrame(rows, "id string, dense array<float>")


def test_dense_and_fusion(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.5, 0.0]), (2, None)], "question_id long, dense array<float>")
    dense = search.dense_topk(asked, vectors(spark), k=2)
    assert [(r.chunk_id, r.rank) for r in dense.orderBy("rank").collect()] == [("c0", 1), ("c1", 2)]
    sparse = spark.createDataFrame([(1, "c1", 9.0, 1)], "question_id long, chunk_id string, score double, rank int")
    fused = search.hybrid_search(dense, sparse, k=5).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["c1", "c0"]
    assert fused[0].fused == pytest.approx(1 / 2 + 1 / 3)


def test_rerank_and_its_failure(spark):
    rows = [(1, "q", "c0", "x", 1), (1, "q", "c1", "best", 2), (2, "q", "c0", "x", 1), (2, "q", "c1", "bad", 2)]
    candidates = spark.createDataFrame(rows, "question_id long, question string, chunk_id string, text string, rank int")

    def score(question, text):
        return text.map({"best": 9.0, "x": -1.5, "bad": None})

    out = {(r.question_id, r.n): (r.chunk_id, r.score) for r in search.rerank(candidates, score, k=2).collect()}
    assert out[(1, 1)] == ("c1", 9.0) and out[(1, 2)] == ("c0", -1.5)
    assert out[(2, 1)] == ("c0", None) and out[(2, 2)] == ("c1", None)
