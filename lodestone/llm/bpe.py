"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

``encode`` gives the ids that the published byte-level vocabulary defines for a text:
the special tokens' strings become their own ids, the rest is cut into pieces by the
published pattern and every piece is merged by rank. ``decode`` is its inverse; bytes
that are no UTF-8 become U+FFFD.

Null texts count as empty and give no ids; empty tables give empty results; repeated
rows are encoded each; columns other than id and text are ignored. Very long texts
are encoded whole. Where an output has the name of an input column, the output stands.

``bpe_round_trip`` encodes and decodes in one pass over Arrow batches, so a text crosses to
Python once and each task has one worker with one vocabulary.

The merges of all new pieces of a batch run together: their symbols lie in one flat
array, the rank of every adjacent pair is found by binary search over the sorted pair
keys, and each round merges, in every piece, its lowest-ranked pair. Pieces met
before are taken from a table that is bounded by ``CACHE_PIECES`` entries and lives as long
as its partition.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, fields, sliced, text_or_empty

#: Pieces that a task remembers; beyond it the table starts anew.
CACHE_PIECES = 150_000
#: A vocabulary is broadcast; this bounds its size.
MAX_VOCAB_BYTES = 64_000_000
_NONE = np.int64(1) << 40
#: Unicode's White_Space, as in a character class.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 stands for itself; the other bytes are numbered from U+0100.
    """
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    other = iter(range(256, 512))
    return [chr(c) if c in set(own) else chr(next(other)) for c in range(256)]


@lru_cache(maxsize=2)
def piece_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """The published splitting pattern for texts of characters up to ``last``.

    \\p{L}, \\p{N} and White_Space are spelt out; short classes make matching faster.
    """
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(last + 1):
        kind = ranges.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            if kind and kind[-1][1] == c - 1:
                kind[-1][1] = c
            else:
                kind.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in "LN")
    return re.compile(
        f" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}{letters}{numbers}]+"
        f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def pieces_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return piece_pattern().findall(text)
    return piece_pattern(255).findall(text)


class ByteBpe:
    """A byte-level BPE vocabulary as arrays."""

    def __init__(self, spec: bytes) -> None:
        config = json.loads(spec)
        vocab: dict[str, int] = config["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in config["model"]["merges"]]
        keys = np.array([self.pair(vocab[a], vocab[b]) for a, b in merges], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.append(order.astype(np.int64), _NONE)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]
        self.special = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        self.special_pattern = (
            re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    @staticmethod
    def pair(a, b):
        return a << 20 | b

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the sorted keys, or -1 where it is no merge."""
        pair = self.pair(left, right).astype(np.uint64)
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, at, -1)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word starts (and the end)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        # spot[i]: place among the merges of the pair that begins at i, -1 for none.
        spot = np.full(len(symbols), -1, dtype=np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        spot[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = self.ranks[spot]  # the last entry, at -1, is the rank of no merge
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            of_word = np.repeat(lowest, np.diff(first, append=len(symbols)))
            over = of_word == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            spots = np.flatnonzero((rank == of_word) & ~over)
            # In a run of overlapping pairs (a a a) every second one is merged, from the left.
            if len(spots) > 1 and (np.diff(spots) == 1).any():
                begins = np.concatenate([[True], np.diff(spots) != 1])
                place = np.arange(len(spots))
                spots = spots[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            symbols[spots] = self.merged[spot[spots]]
            keep = ~over
            keep[spots + 1] = False
            changed = np.zeros(len(symbols), dtype=bool)
            changed[spots] = True
            changed[spots[spots > 0] - 1] = True
            symbols, owner, spot, changed = symbols[keep], owner[keep], spot[keep], changed[keep]
            again = np.flatnonzero(changed)
            spot[again] = -1
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            spot[again] = self.look_up(symbols[again], symbols[again + 1])
        ids = np.concatenate([*done_symbols, np.zeros(0, dtype=np.int64)])
        owner = np.concatenate([*done_owner, np.zeros(0, dtype=np.int32)])
        ids = ids[np.argsort(owner, kind="stable")]
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        return ids.astype(np.int32), np.concatenate([[0], ends])

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not in the table yet and adds them to it."""
        new = list(pieces)
        plain = [p for p in new if p not in self.special]
        ids, starts = self.merge_rounds([p.encode("utf-8", "surrogatepass") for p in plain])
        base = len(self.index)
        for k, p in enumerate(plain):
            self.index[p] = base + k
        parts, bounds = [self.ids, ids], [self.starts, starts[1:] + self.starts[-1]]
        for p in new:
            if p in self.special:
                self.index[p] = len(self.index)
                parts.append(np.array([self.special[p]], dtype=np.int32))
                bounds.append(bounds[-1][-1:] + 1)
        self.ids, self.starts = np.concatenate(parts), np.concatenate(bounds)

    def pieces(self, text: str) -> list[str]:
        find = pieces_of
        if self.special_pattern is None or not self.special_pattern.search(text):
            return find(text)
        out: list[str] = []
        for k, part in enumerate(self.special_pattern.split(text)):
            out += [part] if k % 2 else find(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts (and the end)."""
        if len(self.index) > CACHE_PIECES:
            self.forget()
        cut = [self.pieces(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in cut:
            new.update(words)
        new.difference_update(self.index)
        if new:
            self.learn(new)
        counts = np.array([len(c) for c in cut], dtype=np.int64)
        places = map(self.index.__getitem__, chain.from_iterable(cut))
        rows = np.fromiter(places, dtype=np.int64, count=int(counts.sum()))
        begin, length = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        return flat, ends[np.concatenate([[0], np.cumsum(counts)])]


class Decoder:
    """What each id stands for, in bytes."""

    def __init__(self, spec: bytes) -> None:
        config = json.loads(spec)
        back = {s: bytes([i]) for i, s in enumerate(byte_symbols())}
        tokens = {i: b"".join(back[c] for c in token) for token, i in config["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in config.get("added_tokens", [])}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts whose ids lie in ``flat`` between consecutive bounds."""
        data = b"".join(map(self.tokens.__getitem__, flat.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.lengths[flat])])[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast; its size is checked."""
    with open(path, "rb") as f:
        spec = f.read(MAX_VOCAB_BYTES + 1)
    if len(spec) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(spec)


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _kept(docs: DataFrame, id_col: str, keep: tuple[str, ...], outputs: tuple[str, ...]) -> list[str]:
    return [n for n in dict.fromkeys([id_col, *keep]) if n not in outputs]


def bpe_encode(
    docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id, ids ARRAY<INT>`` and the columns to ``keep``: the token ids of every whole text."""
    spec = _vocabulary(docs.sparkSession, vocab_path)
    names = _kept(docs, id_col, keep, ("ids",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(spec.value)
        for whole in batches:
            for batch in sliced(whole, len(names)):
                ids = _lists(*bpe.encode(batch.column(len(names)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*names, "ids"])

    texts = docs.select(*[F.col(f"`{n}`") for n in names], text_or_empty(text_col).alias("__text"))
    return arrow_map(texts, run, f"{fields(docs, names)}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give the empty text."""
    spec = _vocabulary(encoded.sparkSession, vocab_path)
    names = [c for c in encoded.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = [x or [] for x in batch.column(len(names)).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(bounds[-1]))
                texts = pa.array(decoder.decode(flat, bounds), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, text_col])

    chosen = encoded.select(*[F.col(f"`{n}`") for n in names], F.col(ids_col).alias("__ids"))
    return arrow_map(chosen, run, f"{fields(encoded, names)}, `{text_col}` string")


def bpe_round_trip(
    docs: DataFrame,
    vocab_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    decoded: bool = True,
) -> DataFrame:
    """``id``, the columns to ``keep``, ``ids, n_tokens, round_trip`` and (if asked for) ``decoded``.

    ``round_trip`` says whether the decoded ids give the text back.
    """
    spec = _vocabulary(docs.sparkSession, vocab_path)
    outputs = ("ids", "n_tokens", "round_trip", *(("decoded",) if decoded else ()))
    names = _kept(docs, id_col, keep, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decoder = ByteBpe(spec.value), Decoder(spec.value)
        for whole in batches:
            for batch in sliced(whole, len(names)):
                texts = batch.column(len(names)).to_pylist()
                flat, bounds = bpe.encode(texts)
                back = decoder.decode(flat, bounds)
                found = [
                    _lists(flat, bounds),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    *([pa.array(back, pa.string())] if decoded else []),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*names, *outputs])

    texts = docs.select(*[F.col(f"`{n}`") for n in names], text_or_empty(text_col).alias("__text"))
    kinds = "ids array<int>, n_tokens long, round_trip boolean" + ", decoded string" * decoded
    return arrow_map(texts, run, f"{fields(docs, names)}, {kinds}")
