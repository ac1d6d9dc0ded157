"""Inverted lists of vectors against the scan of the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, vectors


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.Generator(np.random.PCG64(3))
    middles = r.normal(size=(12, 24))
    rows = [(k, (middles[k % 12 if k % 3 else 0] + 0.5 * r.normal(size=24)).astype(float).tolist()) for k in range(3000)]
    rows += [(3000 + k, rows[k][1]) for k in range(40)]  # ties
    rows += [(4000, [0.0] * 24), (4001, None)]
    return spark.createDataFrame(rows, "id long, dense array<double>").repartition(4)


def asked_of(table):
    return table.where("id % 20 = 0").withColumnRenamed("id", "question_id")


def plain(found):
    return sorted(tuple(r) for r in found.select("question_id", "rank", "chunk_id", "score").collect())


def test_exact_search_equals_the_scan_and_lists_find_most(spark, table, tmp_path):
    index = vectors.build_lists(table, f"file://{tmp_path}/lists")
    assert index.rows.count() == 3041 and len(index.centroids) == 55
    assert sum(r["n"] for r in index.lists.collect()) == 3041
    want = plain(search.dense_topk(asked_of(table), table))
    assert plain(vectors.search_lists(asked_of(table), index, exact=True)) == want
    assert plain(vectors.search_lists(asked_of(table), index, exact=True, probes=1)) == want
    few = plain(vectors.search_lists(asked_of(table), index))
    recall = len({(q, c) for q, _, c, _ in few} & {(q, c) for q, _, c, _ in want}) / len(want)
    assert recall >= 0.9
    scored, every = vectors.rows_scored(asked_of(table), index)
    assert every == 3041 * len({q for q, *_ in want}) and scored < 0.5 * every
    again = vectors.open_lists(spark, f"file://{tmp_path}/lists", "id long")
    assert plain(vectors.search_lists(asked_of(table), again)) == few


def test_few_rows_no_rows_and_blocks_of_questions(spark, table, tmp_path, monkeypatch):
    small = table.where("id < 3")
    index = vectors.build_lists(small, f"file://{tmp_path}/small")
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 40)
    got = vectors.search_lists(asked_of(table), index, exact=True)
    assert plain(got) == plain(search.dense_topk(asked_of(table), small))
    none = vectors.build_lists(table.where("id = 4001"), f"file://{tmp_path}/none")
    assert vectors.search_lists(asked_of(table), none).collect() == []
    assert vectors.search_lists(asked_of(table).limit(0), index).collect() == []
    assert vectors.rows_scored(asked_of(table).where(F.lit(False)), index) == (0, 0)


def test_given_table_recall(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    index = vectors.build_lists(rows, f"file://{tmp_path}/given")
    want = {(q, c) for q, _, c, _ in plain(search.dense_topk(asked_of(rows), rows))}
    found = {(q, c) for q, _, c, _ in plain(vectors.search_lists(asked_of(rows), index))}
    assert len(found & want) / len(want) >= 0.9
