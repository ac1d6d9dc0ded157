"""Packed postings: counted beside their chunk, searched and stored without being shuffled by posting."""

import re
import zlib
from collections import Counter

import duckdb

from lodestone.operators import blockmax, bm25
from lodestone.operators.build import build_index
from lodestone.operators import index as ix
from lodestone.plans import index_queries, quality_queries

TEXTS = ["a b a", "b C c", "", None, "!", "x a " * 50]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chunks(spark):
    return spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(TEXTS)], "id string, text string")


def test_postings_are_counted_without_a_shuffle(spark):
    found = bm25.term_frequencies(chunks(spark))
    assert "Exchange" not in plan(found)
    want = {(f"c{k}", zlib.crc32(w.encode())): n for k, t in enumerate(TEXTS) for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items()}
    assert {(r.chunk_id, r.term_index): r.tf for r in found.collect()} == want
    words = bm25.term_frequencies(chunks(spark), hashed=False).where("chunk_id = 'c1'").collect()
    assert sorted((r.term_index, r.tf, r.dl) for r in words) == [("b", 1, 3), ("c", 2, 3)]


def test_packed_and_raw_postings_give_the_same_hits(spark, tmp_path, monkeypatch):
    docs = chunks(spark).where("text is not null")
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["a", "b c", "x b", "none"])], "question_id long, question string")
    raw, packed, stats = bm25.term_frequencies(docs), bm25.packed_postings(docs), bm25.corpus_stats(docs)
    rows = lambda found: sorted(tuple(r) for r in found.select("question_id", "rank", "chunk_id", "score").collect())
    want = rows(bm25.sparse_topk(asked, raw, stats))
    assert rows(bm25.sparse_topk(asked, packed, stats)) == want and len(want) == 7
    index = blockmax.build_blocks(packed, stats, f"file://{tmp_path}/blocks")
    assert rows(blockmax.blockmax_topk(asked, index)) == want
    monkeypatch.setattr(bm25, "QUESTIONS", 1)
    assert rows(bm25.sparse_topk(asked, packed, stats)) == want


def _connector():
    return lambda: lambda texts, task: [[1.0] for _ in texts]


def test_a_build_stores_postings_by_chunk(spark, tmp_path):
    articles = spark.createDataFrame([("d", "s", "# T\n\na a b\n\n## h\n\nc")], "article_type string, article_slug string, text string")
    build_index(articles, f"file://{tmp_path}/index", _connector(), 1, max_tokens=None)
    s = ix.opened(spark, f"file://{tmp_path}/index")
    assert s.packed("postings").count() == s.table("chunks").count() == 2
    assert s.table("postings").count() > 2


def test_the_sql_counts_terms_as_the_index_knows_them():
    words = ["plumless", "buckeroo", "é", "đ", "a_1"]  # the first two collide
    rows = duckdb.sql(f"WITH now_words AS (SELECT 1 AS id, {words} AS ws) {index_queries.CRC_SQL} SELECT term, term_index FROM crcs").fetchall()
    assert dict(rows) == {w: zlib.crc32(w.encode()) for w in words}


def test_candidates_of_the_evaluation_are_searched_once(spark):
    assert "MapInArrow" not in plan(quality_queries.records(spark, "/root/testdata/sf0.001"))
