"""A training-corpus pipeline over ``documents``, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; every stage but the
last returns the columns it was given. ``run`` writes each result as Parquet into the
shared folder and reads it back as the next stage's input, so a lost executor never
repeats what came before. A run that failed starts anew, under new names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bpe import bpe_round_trip
from lodestone.llm.common import load, stored
from lodestone.llm.exact_dedup import drop_copies
from lodestone.llm.jaccard_join import keep_one_of_each
from lodestone.llm.mixing import sample_to_targets
from lodestone.llm.queries import vocabulary
from lodestone.llm.toxicity import drop_toxic, fitted_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the fitted network scores at the threshold or above."""
    return drop_toxic(docs, fitted_on(docs, load(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of near-duplicates."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their raked probabilities."""
    return sample_to_targets(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, with ``ids, n_tokens, round_trip`` of every document, in one pass."""
    keep = tuple(c for c in docs.columns if c != "text")
    return bpe_round_trip(docs, vocabulary(), keep=keep, decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: No SQL can express the network's scores; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
