"""An index of vectors by inverted lists: k-means lists, routed questions, bounds for an exact search.

Unit vectors are assigned to the nearest of some centroids and stored by that list, each with
its distance from the centroid. A question is routed to the lists of its nearest centroids and
scored against their rows only. Since ``q·x = q·c + q·(x - c) <= q·c + |x - c|``, the k-th best score found
there tells which other lists, and which of their rows, could still hold a better one: the
exact search scans those too, and no others, and equals the scan of the whole table.

Centroids are fitted in one task on a bounded sample (``SAMPLE`` vectors in the order of a
hash of their ids); every row is assigned and stored. Rows without a vector are left out, a vector of
zeros has score 0 with everything. A list that holds most rows is several files,
read by as many tasks; nothing is grouped by list.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.bm25 import ranked
from lodestone.operators.search import INDEX_ROWS, QUESTION_BLOCK, K
from lodestone.sources.tables import materialised

SAMPLE, MAX_LISTS, ROUNDS = 32_768, 1024, 12
#: The share of nearest neighbours that the default number of probes shall find, and the sample's rows that are asked for it.
RECALL, ASKED = 0.96, 512
#: Scores are compared after rounding, so bounds get as much room.
ROOM = 1e-8


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long number lists without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def spherical_means(vectors: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids: each round the mean of the vectors nearest to each; an empty one moves to the vector worst served."""
    r = np.random.Generator(np.random.PCG64(seed))
    centroids = vectors[r.choice(len(vectors), size=min(lists, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = vectors @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = vectors[np.argsort(near[np.arange(len(own)), own])[: len(empty)]]
        centroids = unit(sums)
    return centroids


def probes_for(vectors: np.ndarray, centroids: np.ndarray, recall: float = RECALL, k: int = K) -> int:
    """The fewest lists that hold ``recall`` of the k nearest others of the first ``ASKED`` vectors."""
    asked = vectors[:ASKED]
    near = asked @ vectors.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    others = np.argsort(-near, axis=1)[:, : min(k, len(vectors) - 1)]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, (vectors @ centroids.T).argmax(axis=1)[others], axis=1) + 1
    return int(np.quantile(needed, recall, method="higher")) if needed.size else 1


@dataclass
class VectorLists:
    """``rows``: ``list, id, vector, away``; ``lists``: ``list, n, furthest``, one row per centroid that has rows.

    ``probes`` is how many lists a question is routed to if it is not said; the fit has measured it on the sample.
    """

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int
    rows: DataFrame
    lists: DataFrame


def _fitted(vectors: DataFrame, lists: int) -> tuple[np.ndarray, int]:
    """Centroids fitted on the sample, and the probes that they need, in one task."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [matrix(b.column(0)) for b in batches if b.num_rows]
        if held:
            sampled = unit(np.concatenate(held))
            found = spherical_means(sampled, lists)
            made = [pa.array(found.tolist(), pa.list_(pa.float64())), pa.array([probes_for(sampled, found)] * len(found), pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["centroid", "probes"])

    rows = sample.mapInArrow(run, "centroid array<double>, probes int").collect()
    return np.array([r["centroid"] for r in rows]), rows[0]["probes"] if rows else 1


def build_lists(index: DataFrame, path: str, vector: str = "dense", id_col: str = "id", lists: int | None = None) -> VectorLists:
    """Assigns and stores all rows at ``path``; about the square root of their number in lists, ``MAX_LISTS`` at most."""
    spark = index.sparkSession
    vectors = index.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).where(F.col(vector).isNotNull())
    centroids, probes = _fitted(vectors, lists or min(MAX_LISTS, max(1, round(vectors.count() ** 0.5))))
    known = spark.sparkContext.broadcast(centroids)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, INDEX_ROWS):
                batch = whole.slice(at, INDEX_ROWS)
                rows = unit(matrix(batch.column(1)))
                own = (rows @ known.value.T).argmax(axis=1)
                away = np.linalg.norm(rows - known.value[own], axis=1)
                made = [batch.column(0), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array(own.astype(np.int32)), pa.array(away)]
                yield pa.RecordBatch.from_arrays(made, names=["id", "vector", "list", "away"])

    assigned = vectors.mapInArrow(run, f"id {kind}, vector array<double>, list int, away double")
    assigned.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    stored = spark.read.schema(assigned.schema).parquet(f"{path}/rows") if len(centroids) else assigned
    stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("furthest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(json.dumps(centroids.tolist()), probes)], "centroids string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return open_lists(spark, path, f"id {kind}")


def open_lists(spark: SparkSession, path: str, id_field: str = "id string") -> VectorLists:
    fitted = spark.read.parquet(f"{path}/centroids").first()
    centroids = np.array(json.loads(fitted["centroids"]))
    schema = f"{id_field}, vector array<double>, away double, list int"
    rows = spark.read.schema(schema).parquet(f"{path}/rows") if len(centroids) else spark.createDataFrame([], schema)
    return VectorLists(spark, path, centroids, fitted["probes"], rows, spark.read.schema("list int, n long, furthest double").parquet(f"{path}/lists"))


class Best:
    """The k best rows per question so far."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, None

    def add(self, asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the questions ``asked`` with the rows ``ids``; minus infinity stands for no pair."""
        if not len(ids):
            return
        # All rows that reach the k-th best score, ties included; the sort below cuts them.
        place = max(0, len(ids) - self.k)
        least = np.partition(scores, place, axis=1)[:, place]
        q, row = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        new = pd.DataFrame({"q": asked[q], "id": ids[row], "score": scores[q, row]})
        both = new if self.found is None else pd.concat([self.found, new])
        self.found = both.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(self.k)

    def batch(self, names: list) -> Iterator[pa.RecordBatch]:
        if self.found is not None:
            out = pd.DataFrame({"question_id": [names[q] for q in self.found["q"]], "chunk_id": self.found["id"], "score": self.found["score"]})
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)


def _scan(index: VectorLists, names: list, vectors: np.ndarray, wanted: np.ndarray, least: np.ndarray, k: int, digits: int, schema: str) -> DataFrame:
    """The k best of each partition among the lists ``wanted`` (questions × lists) and rows whose bound reaches ``least``."""
    lists = np.flatnonzero(wanted.any(axis=0)).tolist()
    given = index.spark.sparkContext.broadcast((names, vectors, wanted, vectors @ index.centroids.T, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, wanted, near, least = given.value
        best = Best(k)
        for whole in batches:
            for at in range(0, whole.num_rows, INDEX_ROWS):
                batch = whole.slice(at, INDEX_ROWS)
                own = batch.column(3).to_numpy()
                for number in np.unique(own):
                    asked = np.flatnonzero(wanted[:, number])
                    some = batch.filter(pa.array(own == number))
                    bound = near[asked, number][:, None] + some.column(2).to_numpy()[None, :]
                    possible = bound >= least[asked][:, None] - ROOM
                    rows, questions = possible.any(axis=0), possible.any(axis=1)
                    if not rows.any():
                        continue
                    some, asked, possible = some.filter(pa.array(rows)), asked[questions], possible[questions][:, rows]
                    scores = np.where(possible, np.round(vectors[asked] @ matrix(some.column(1)).T, digits), -np.inf)
                    best.add(asked, np.array(some.column(0).to_pylist(), dtype=object), scores)
        yield from best.batch(names)

    # The list is the folder: only wanted lists' files are read.
    found = index.rows.where(F.col("list").isin(lists)).select("id", "vector", "away", "list").mapInArrow(run, schema)
    local = materialised(found, "list-candidates")
    given.destroy()
    return local


def _routed(index: VectorLists, vectors: np.ndarray, probes: int) -> np.ndarray:
    near = vectors @ index.centroids.T
    chosen = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    wanted = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(wanted, chosen, True, axis=1)
    return wanted


def _blocks(questions: DataFrame, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Questions with a vector, ``QUESTION_BLOCK`` at a time (about), as names and unit vectors."""
    stored = materialised(questions.select("question_id", vector).where(F.col(vector).isNotNull()), "question-vectors")
    blocks = max(1, -(-stored.count() // QUESTION_BLOCK))
    for block in range(blocks):
        got = stored.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if got.num_rows:
            yield got["question_id"].to_pylist(), unit(matrix(got[vector].combine_chunks()))


def search_lists(
    questions: DataFrame, index: VectorLists, k: int = K, probes: int | None = None, exact: bool = False, vector: str = "dense", digits: int = 9
) -> DataFrame:
    """``question_id, chunk_id, score, rank`` by cosine, from the ``probes`` nearest lists of each question (the index' own number without it).

    With ``exact`` the lists and rows that could beat what these gave are scanned as well. Questions
    go through in blocks; what a block has found is stored before the next.
    """
    q_type, id_type = questions.schema["question_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    schema = f"question_id {q_type}, chunk_id {id_type}, score double"
    parts = [index.spark.createDataFrame([], schema)]
    if len(index.centroids):
        furthest = np.full(len(index.centroids), -np.inf)
        for row in index.lists.collect():  # MAX_LISTS rows at most
            furthest[row["list"]] = row["furthest"]
        for names, vectors in _blocks(questions, vector):
            wanted = _routed(index, vectors, probes or index.probes)
            nothing = np.full(len(names), -np.inf)
            parts.append(_scan(index, names, vectors, wanted, nothing, k, digits, schema))
            if exact:
                kth = {r["question_id"]: r["score"] for r in ranked(parts[-1], k).where(F.col("rank") == k).select("question_id", "score").collect()}
                least = np.array([kth.get(n, -np.inf) for n in names])
                more = (vectors @ index.centroids.T + furthest[None, :] >= least[:, None] - ROOM) & ~wanted
                parts.append(_scan(index, names, vectors, more, least, k, digits, schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return ranked(found, k)


def rows_scored(questions: DataFrame, index: VectorLists, probes: int | None = None, vector: str = "dense") -> tuple[int, int]:
    """How many pairs of question and row a search by ``probes`` lists scores, and how many there are."""
    n = np.zeros(len(index.centroids))
    for row in index.lists.collect():
        n[row["list"]] = row["n"]
    scored = asked = 0
    for names, vectors in _blocks(questions, vector):
        scored, asked = scored + int((_routed(index, vectors, probes or index.probes) * n).sum()), asked + len(names)
    return scored, asked * int(n.sum())
