"""Word shingles as 64-bit hashes, in numpy, and what a whole corpus says about them."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

WORDS = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
#: Word hashes that a task remembers; beyond it the table starts anew.
CACHE_WORDS = 200_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case, cut at [\\x20\\x09-\\x0D]."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Shingled:
    """The words and distinct shingles of a block of texts."""

    def __init__(self, texts: list[str | None], hashes: WordHashes) -> None:
        cut = [words_of(t) for t in texts]
        self.counts = np.array([len(c) for c in cut], dtype=np.int64)
        total = int(self.counts.sum())
        self.words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(cut)), dtype=np.uint64, count=total)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        padded = np.concatenate([self.words, np.zeros(WORDS, dtype=np.uint64)])
        h = np.zeros(total, dtype=np.uint64)
        for j in range(WORDS):
            h += padded[j : j + total] * _MULTIPLIERS[j]
        self.at_word = mixed(h)

    def short(self, k: int) -> np.ndarray:
        """A text of fewer than five words: its whole sequence is its one shingle."""
        words = self.words[self.starts[k] : self.starts[k + 1]]
        h = (words * _MULTIPLIERS[: len(words)]).sum(dtype=np.uint64, keepdims=True)
        return mixed(h + np.uint64(len(words) * 0x632BE59BD9B4E019 % (1 << 64)))

    def set_of(self, k: int) -> np.ndarray:
        """Sorted distinct shingles of text ``k``."""
        n = int(self.counts[k])
        if n == 0:
            return np.zeros(0, dtype=np.uint64)
        if n < WORDS:
            return self.short(k)
        return np.unique(self.at_word[self.starts[k] : self.starts[k] + n - WORDS + 1])

    def set_with_scores(self, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of text ``k`` and the sum of their words' scores."""
        n = int(self.counts[k])
        if n < WORDS:
            own = self.set_of(k)
            return own, np.zeros(len(own), dtype=np.int64)
        at = int(self.starts[k])
        own, first = np.unique(self.at_word[at : at + n - WORDS + 1], return_index=True)
        sums = np.concatenate([[0], np.cumsum(scores[at : at + n])])
        return own, sums[first + WORDS] - sums[first]
