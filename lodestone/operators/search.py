"""Dense search, reciprocal rank fusion and reranking for many questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.best import Best
from lodestone.operators.bm25 import ranked
from lodestone.sources.tables import materialised

K, CANDIDATES, RRF_K = 5, 20, 2
#: Question vectors that are broadcast at once.
QUESTION_BLOCK = 4096
#: Index rows that are scored at once.
INDEX_ROWS = 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def dense_topk(
    questions: DataFrame, index: DataFrame, k: int = K, vector: str = "dense", id_col: str = "id", digits: int = 9
) -> DataFrame:
    """``question_id, chunk_id, score, rank``: nearest chunks by cosine.

    The index is scanned once per block of ``QUESTION_BLOCK`` question vectors and never
    shuffled: each partition multiplies matrices and passes on its own k best.
    """
    id_type, q_type = (d.schema[c].dataType.simpleString() for d, c in ((index, id_col), (questions, "question_id")))
    schema = f"question_id {q_type}, chunk_id {id_type}, score double"
    questions = materialised(questions.select("question_id", vector), "question-vectors")
    n = questions.count()
    blocks = max(1, -(-n // QUESTION_BLOCK))
    rows = index.select(F.col(id_col), F.col(vector))
    spark = questions.sparkSession
    parts = []
    for block in range(blocks):
        chosen = questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        got = chosen.select("question_id", vector).where(F.col(vector).isNotNull()).toPandas()
        if not len(got):
            continue
        asked = spark.sparkContext.broadcast((got["question_id"].tolist(), _unit(np.array(got[vector].tolist(), dtype=np.float64))))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            names, matrix = asked.value
            best = Best(len(names), k)
            for batch in (whole.slice(at, INDEX_ROWS) for whole in batches for at in range(0, whole.num_rows, INDEX_ROWS)):
                keep = batch.filter(pa.compute.is_valid(batch.column(1)))
                if not keep.num_rows:
                    continue
                flat = keep.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                best.add(keep.column(0), np.round(_unit(flat.reshape(keep.num_rows, -1)) @ matrix.T, digits))
            if (out := best.batch(names)) is not None:
                yield out

        found = rows.mapInArrow(run, schema)
        if blocks > 1:
            # Of many blocks one at a time is broadcast, and what it has found is stored.
            found = materialised(found, "block-candidates")
            asked.destroy()
        parts.append(found)
    if not parts:
        return ranked(spark.createDataFrame([], schema), k)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return ranked(every, k)


def fuse(*lists: DataFrame, k: int = K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: score = sum of 1 / (rrf_k + rank - 1)."""
    union = lists[0].select("question_id", "chunk_id", "rank")
    for more in lists[1:]:
        union = union.unionByName(more.select("question_id", "chunk_id", "rank"))
    scores = union.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank") - 1)), 12).alias("score"))
    return ranked(scores, k)


def hybrid_search(dense: DataFrame, sparse: DataFrame, k: int = K, rerank: bool = False) -> DataFrame:
    """Fused candidates; k of them, or all ``CANDIDATES`` when a reranker follows."""
    return fuse(dense, sparse, k=CANDIDATES if rerank else k).withColumnRenamed("score", "fused")


def rerank(
    candidates: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series] | Column, k: int = K
) -> DataFrame:
    """Candidates (``question_id, question, chunk_id, text, rank``) in the order of a scorer.

    ``score`` is a column, or a vectorised function of questions and texts. If any score
    of a question is null or not finite, the question keeps its order and has null scores.
    """
    value = score if isinstance(score, Column) else F.pandas_udf(score, "double")("question", "text")
    scored = candidates.withColumn("raw", value.cast("double"))
    of_question = Window.partitionBy("question_id")
    bad = F.col("raw").isNull() | F.isnan("raw") | (F.abs("raw") == float("inf"))
    judged = scored.withColumn("ok", F.count_if(bad).over(of_question) == 0)
    kept = judged.withColumn("score", F.when(F.col("ok"), F.col("raw")))
    order = of_question.orderBy(F.desc_nulls_last("score"), "rank")
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("raw", "ok")
