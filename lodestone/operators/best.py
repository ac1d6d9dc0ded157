"""The k best rows of a task per question: what a search passes on."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa


class Best:
    """Rows are taken in by blocks of scores; at most k a question are held, ties by id."""

    def __init__(self, n_questions: int, k: int) -> None:
        self.k, self.least = k, np.full(n_questions, -np.inf)
        self.held: pd.DataFrame | None = None

    def add(self, ids: pa.Array, scores: np.ndarray, found: np.ndarray | None = None) -> None:
        """``scores``: a row per id, a column per question; ``found``: which of them count."""
        good = scores >= self.least if found is None else found & (scores >= self.least)
        if len(scores) > self.k and np.count_nonzero(good) > 4 * self.k * scores.shape[1]:
            # All rows that reach the k-th best score of the block, ties included; the sort below cuts them.
            good &= scores >= np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
        row, q = np.nonzero(good)
        if not len(row):
            return
        own, at = np.unique(row, return_inverse=True)
        names = np.array(ids.take(pa.array(own)).to_pylist(), dtype=object)
        some = pd.DataFrame({"q": q, "chunk_id": names[at], "score": scores[row, q]})
        every = some if self.held is None else pd.concat([self.held, some])
        self.held = every.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True]).groupby("q").head(self.k)
        sizes = self.held.groupby("q")["score"].agg(["size", "min"])
        full = sizes[sizes["size"] == self.k]
        self.least[full.index.to_numpy()] = full["min"].to_numpy()

    def batch(self, names: list) -> pa.RecordBatch | None:
        """``question_id, chunk_id, score`` of what is held, by the questions' ``names``."""
        if self.held is None:
            return None
        out = pd.DataFrame({"question_id": [names[q] for q in self.held["q"]], "chunk_id": self.held["chunk_id"], "score": self.held["score"]})
        return pa.RecordBatch.from_pandas(out, preserve_index=False)
