"""A word segmenter: collocations counted in Spark, best paths through each text.

Some languages write a word as several space-separated syllables. Pairs of neighbouring words that
occur together far more often than their parts would by chance are taken for one word: a lexicon with
a weight each (normalised pointwise mutual information). A text is segmented by the set of
non-overlapping pairs of the greatest total weight; each is joined by ``_``.
Pairs are neighbours when exactly one space is between them.

The lexicon is cut to ``LEXICON`` pairs of ``PAIR_BYTES`` bytes at most (in order of weight), as it is broadcast to
every task; counting covers all texts. Null texts stay null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXICON, PAIR_BYTES = 50_000, 128
LEAST_COUNT, LEAST_WEIGHT = 5, 0.5
WORD = re.compile(r"[^\W_]+")
#: What parts runs of words between which there are single spaces.
_BETWEEN = r"[^\p{L}\p{N} ]+| {2,}"


def collocations(texts: DataFrame, text_col: str = "text", least_count: int = LEAST_COUNT, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """``first, second, n, weight``: pairs of words (lower case) that belong together, counted over all texts.

    Runs of words parted by single spaces are split by built-in functions; counts of pairs and of words
    are combined before they are shuffled.
    """
    pieces = F.transform(F.split(F.lower(F.col(text_col)), _BETWEEN), lambda x: F.trim(x))
    runs = texts.select(F.explode(F.filter(pieces, lambda x: x != "")).alias("run"))
    words = runs.select(F.split("run", " ").alias("w"))
    single = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = single.agg(F.sum("n").alias("total"))
    pairs = words.select(F.explode(F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> IF(i < size(w), named_struct('first', w[i - 1], 'second', w[i]), NULL))")).alias("p"))
    counted = pairs.where("p is not null").groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    first, second = (single.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")) for c in ("first", "second"))
    known = counted.join(first, "first").join(second, "second").join(F.broadcast(total), F.lit(True))
    together = F.log(F.col("n") * F.col("total") / (F.col("n_first") * F.col("n_second")))
    rated = known.select("first", "second", "n", F.round(together / -F.log(F.col("n") / F.col("total")), 9).alias("weight"))
    return rated.where(F.col("weight") >= least_weight)


def cut_lexicon(pairs: DataFrame, size: int = LEXICON) -> DataFrame:
    """The ``size`` pairs of the greatest weight (ties by their words)."""
    short = F.octet_length("first") + F.octet_length("second") <= PAIR_BYTES
    return pairs.where(short).orderBy(F.desc("weight"), "first", "second").limit(size)


def best_path(weights: list[float]) -> list[int]:
    """Which of the neighbouring pairs with ``weights`` (0: none) are joined: no two that share a word, of the greatest sum.

    Of equal sums the one that joins later pairs only where it must.
    """
    best, taken = [0.0, 0.0], []
    for w in weights:
        joined = best[-2] + w
        taken.append(w > 0 and joined > best[-1])
        best.append(joined if taken[-1] else best[-1])
    chosen, at = [], len(weights) - 1
    while at >= 0:
        if taken[at]:
            chosen.append(at)
            at -= 2
        else:
            at -= 1
    return chosen[::-1]


def segmented(text: str, lexicon: dict[tuple[str, str], float]) -> str:
    """One text with its compounds joined."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    low = [text[a:b].lower() for a, b in words]
    weights = [
        lexicon.get((low[k], low[k + 1]), 0.0) if words[k + 1][0] == words[k][1] + 1 and text[words[k][1]] == " " else 0.0 for k in range(len(words) - 1)
    ]
    out, at = [], 0
    for k in best_path(weights):
        out += [text[at : words[k][1]], "_"]
        at = words[k + 1][0]
    return "".join([*out, text[at:]])


def segmenter(lexicon: DataFrame) -> Callable[[Column], Column]:
    """The ``segment`` function of an index build: a column of texts to a column of segmented texts."""
    rows = lexicon.select("first", "second", "weight").limit(LEXICON).collect()
    known = lexicon.sparkSession.sparkContext.broadcast({(r["first"], r["second"]): r["weight"] for r in rows})

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else segmented(t, known.value))

    return lambda text: run(text)
