"""A subword token counter: greedy longest match over a given vocabulary, for many texts at once.

The vocabulary's pieces (bytes) are a trie in flat arrays: the sorted numbers ``node * 256 + byte`` of its edges,
and whether a piece ends at a node. At every byte of all texts the longest piece is found together, one
level of the trie after the other; then all texts take one piece each at a time. A byte
that no piece begins with counts as one token. Null texts count as empty.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A vocabulary goes to every task, so its size is checked; longer pieces are left out.
MOST_PIECES, PIECE_BYTES = 1_000_000, 64
#: Characters up to which a text on its own is counted by a plain loop.
SHORT = 128


class Subwords:
    def __init__(self, pieces: Iterable[bytes]) -> None:
        level = sorted({p for p in pieces if 0 < len(p) <= PIECE_BYTES})
        if len(level) > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        nodes, edges, ends = {b"": 0}, [], [False]
        for piece in level:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(ends)
                    edges.append((nodes[piece[: n - 1]] * 256 + piece[n - 1], len(ends)))
                    ends.append(False)
            ends[nodes[piece]] = True
        edges.sort()
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.to = np.array([t for _, t in edges], dtype=np.int64)
        self.ends = np.array(ends)
        self.pieces, self.most = frozenset(level), max(map(len, level), default=1)

    def longest(self, data: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The bytes of the longest piece at every place, 1 where there is none; ``stop`` is where each place's text ends."""
        found = np.ones(len(data), dtype=np.int64)
        at, node = np.arange(len(data)), np.zeros(len(data), dtype=np.int64)
        depth = 0
        while len(at) and len(self.keys):
            key = node * 256 + data[at + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            at, node, depth = at[there], self.to[edge[there]], depth + 1
            found[at[self.ends[node]]] = depth
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        return found

    def counts(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode() for t in texts]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        step = self.longest(np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64), np.repeat(bounds[1:], sizes))
        at, total = bounds[:-1].copy(), np.zeros(len(raw), dtype=np.int64)
        open_ones = np.flatnonzero(at < bounds[1:])
        while len(open_ones):
            total[open_ones] += 1
            at[open_ones] += step[at[open_ones]]
            open_ones = open_ones[at[open_ones] < bounds[1:][open_ones]]
        return total

    def __call__(self, text: str) -> int:
        """One text; a short one (a splitter asks for many) is not worth setting up arrays."""
        if len(text) > SHORT:
            return int(self.counts([text])[0])
        data, at, n = text.encode(), 0, 0
        while at < len(data):
            size = min(self.most, len(data) - at)
            while size > 1 and data[at : at + size] not in self.pieces:
                size -= 1
            at, n = at + size, n + 1
        return n


def from_ranks(path: str) -> Subwords:
    """A vocabulary of lines ``<base64 of the piece> <rank>``, read on the driver."""
    with open(path, "rb") as lines:
        return Subwords(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def counting(spark: SparkSession, subwords: Subwords) -> dict[str, Callable]:
    """``counter`` and ``count_column`` for ``chunk_articles``: the cap is then measured in these tokens."""
    known = spark.sparkContext.broadcast(subwords)

    @F.pandas_udf("int")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(known.value.counts(texts.tolist()), dtype="int32")

    def counter(text: str) -> int:
        return known.value(text)

    def count_column(text: Column) -> Column:
        return column(text)

    return {"counter": counter, "count_column": count_column}
