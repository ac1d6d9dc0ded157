"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last eight bytes ends a chunk wherever it is -1 modulo the block
size (3 * 2^i, picked from the text so that about 32 to 64 chunks result). Each chunk
gives one of 64 characters. A fingerprint ``size:chunks:chunks at twice the size`` is
compared with another by edit distance (insertions and deletions) where their block
sizes are equal or differ by a factor of two; otherwise their likeness is 0.

Null texts count as empty; the fingerprint of the empty text is ``3::`` and two of
them are alike (1.0). Equal texts have equal fingerprints. Repeated rows are separate
documents; with equal ids the order is by text. A null id sorts below all others. An
empty table gives an empty result, and columns other than id and text are ignored. Very long
texts are hashed whole.

``neighbour_fingerprints`` needs the text of the next document. One range shuffle by id
puts neighbours into the same partition; only the first and last text of each partition
meet in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, stored, text_or_empty

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
LONGEST = 64
WINDOW = 8
_GEAR = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 32, 256, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 2_000_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def fingerprints(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """``(block size, chunks, chunks at twice the size)`` of each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    gap = b"\0" * WINDOW
    data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    starts = WINDOW + np.concatenate([[0], np.cumsum(lengths + WINDOW)[:-1]]).astype(np.int64)
    inside = np.zeros(len(data), dtype=bool)
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)

    h = np.where(inside, _GEAR[data], np.uint32(0))
    multiplier = np.uint32(0x01000193)
    for width in (1, 2, 4):
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + older * np.uint32(pow(int(multiplier), width, 1 << 32))
    value = ((h ^ h >> np.uint32(15)) & np.uint32(0x7FFFFFFF)) + np.uint32(1)
    at = np.flatnonzero(inside & (value % np.uint32(3) == 0))
    level = np.minimum(np.bitwise_count((value[at] & -value[at].astype(np.int64)) - 1), 30).astype(np.int64)
    owner = np.searchsorted(starts, at, side="right") - 1

    # Triggers of each text by level; the highest level with 31 of them is taken.
    by_level = np.bincount(owner * 32 + level, minlength=32 * len(texts)).reshape(-1, 32)
    at_least = by_level[:, ::-1].cumsum(axis=1)[:, ::-1]
    most = np.maximum(0, np.ceil(np.log2(np.maximum(lengths, 1) / (3 * LONGEST)))).astype(np.int64)
    enough = (at_least >= LONGEST // 2 - 1) & (np.arange(32) <= most[:, None])
    chosen = np.where(enough.any(axis=1), 31 - enough[:, ::-1].argmax(axis=1), 0)

    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(data)))
    back = _powers(_BACK, len(data))
    signatures: list[list[bytes]] = []
    for more, cap in ((0, LONGEST), (1, LONGEST // 2)):
        mine = level >= (chosen + more)[owner]
        ends, of = at[mine], owner[mine]
        first = np.searchsorted(of, np.arange(len(texts)))
        early = np.arange(len(of)) - first[of] < cap - 1
        ends, of = ends[early], of[early]
        # The rest of each text is its last chunk.
        rest = np.flatnonzero(lengths > 0)
        ends = np.concatenate([ends, starts[rest] + lengths[rest] - 1])
        of = np.concatenate([of, rest])
        order = np.lexsort((ends, of))
        ends, of = ends[order], of[order]
        new = np.ones(len(of), dtype=bool)
        new[1:] = of[1:] != of[:-1]
        begin = np.where(new, starts[of], np.concatenate([[0], ends[:-1] + 1])) if len(of) else ends
        real = begin <= ends
        begin, ends, of = begin[real], ends[real], of[real]
        code = _mixed((sums[ends] - sums[begin - 1]) * back[begin]) >> np.uint64(58)
        letters = ALPHABET[code.astype(np.int64)].tobytes()
        cut = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        signatures.append([letters[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return [(3 << int(c), a, b) for c, a, b in zip(chosen, *signatures, strict=True)]


def written(fingerprint: tuple[int, bytes, bytes]) -> str:
    return f"{fingerprint[0]}:{fingerprint[1].decode()}:{fingerprint[2].decode()}"


def _indel_likeness(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """1 - (insertions and deletions) / (both lengths), by bit-parallel longest common subsequence."""
    n = len(left)

    def padded(rows: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(r.ljust(LONGEST, b"\0") for r in rows), dtype=np.uint8).reshape(n, LONGEST)

    a, b = padded(left), padded(right)
    rows = np.arange(n)
    masks = np.zeros((n, 128), dtype=np.uint64)
    for j in range(LONGEST):
        masks[rows, a[:, j]] |= np.uint64(1 << j)
    masks[:, 0] = 0
    v = np.full(n, ~np.uint64(0))
    for j in range(LONGEST):
        m = masks[rows, b[:, j]]
        u = v & m
        v = (v + u) | (v & ~m)
    common = np.bitwise_count(~v).astype(np.float64)
    total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], dtype=np.float64)
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def likeness(left: list[tuple[int, bytes, bytes]], right: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Likeness (0 to 1) of each pair of fingerprints."""
    out = np.zeros(len(left))
    which, a, b = [], [], []
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        pairs = []
        if x[0] == y[0]:
            pairs = [(x[1], y[1]), (x[2], y[2])]
            if x == y:
                out[k] = 1.0
                continue
        elif x[0] == 2 * y[0]:
            pairs = [(x[1], y[2])]
        elif y[0] == 2 * x[0]:
            pairs = [(x[2], y[1])]
        for p, q in pairs:
            if p and q:
                which.append(k)
                a.append(p)
                b.append(q)
    if which:
        np.maximum.at(out, which, _indel_likeness(a, b))
    return out


def _described(texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns of texts whose next documents are ``following``."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    raw = [t.encode() for t in edited]
    own = fingerprints([t.encode() for t in texts])
    changed = fingerprints(raw)
    then = fingerprints([t.encode() for t in following[-1:]])
    # Inside a block the next document's fingerprint is the next row's.
    after = own[1:] + then
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
        "fingerprint": [written(f) for f in own],
        "edited_fingerprint": [written(f) for f in changed],
        "near_edited": likeness(own, changed).tolist(),
        "near_next": likeness(own, after).tolist(),
    }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about ``BLOCK_BYTES`` of text at a time."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for i, t in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held > BLOCK_BYTES:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of every text; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            marks = [written(f) for f in fingerprints([t.encode() for t in texts])]
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], ids[0].type), pa.array(marks)], names=[id_col, "fingerprint"])

    return arrow_map(docs.select(F.col(id_col), text_or_empty(text_col).alias(text_col)), run, f"`{id_col}` {kind}, fingerprint string")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and two likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many
    (or all) of the next document by descending id; after the last comes the first.
    ``near_edited`` compares with the edited text, ``near_next`` with the next document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in _RESULT.split(", ")), "__kind", "__part", "__text"]
    schema = f"`{id_col}` {kind}, {_RESULT}, __kind int, __part int, __text string"

    def batch_of(ids: list, columns: dict[str, list], kinds: int, texts: list[str | None]) -> pa.RecordBatch:
        n = len(ids)
        arrays = [pa.array([i.as_py() for i in ids], ids[0].type)]
        arrays += [pa.array(columns.get(c, [None] * n), t) for c, t in zip(names[1:7], _TYPES, strict=True)]
        part = TaskContext.get().partitionId()
        arrays += [pa.array([kinds] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows but the last of a partition; kind 1 and 2 are its first and last text."""
        held_id, held_text = None, None
        for ids, texts in _blocks(batches):
            if held_id is None:
                yield batch_of(ids[:1], {}, 1, texts[:1])
            else:
                ids, texts = [held_id, *ids], [held_text, *texts]
            held_id, held_text = ids[-1], texts[-1]
            if len(ids) > 1:
                yield batch_of(ids[:-1], _described(texts[:-1], texts[1:]), 0, [None] * (len(ids) - 1))
        if held_id is not None:
            yield batch_of([held_id], {}, 2, [held_text])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, following = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                row = batch_of([batch.column(0)[k]], _described([text], [following]), 0, [None])
                yield row.select(names[:7])

    ordered = (
        docs.select(F.col(id_col), text_or_empty(text_col).alias(text_col))
        .repartitionByRange(F.col(id_col).desc_nulls_last())
        .sortWithinPartitions(F.col(id_col).desc_nulls_last(), F.col(text_col))
    )
    done = stored(arrow_map(ordered, inner, schema), "fingerprints")
    # One number for each partition that has rows, so the driver holds no data.
    everything = Window.partitionBy(F.lit(1))
    parts = done.where("__kind = 1").select("__part")
    follows = parts.select(
        "__part",
        F.coalesce(F.lead("__part").over(everything.orderBy("__part")), F.min("__part").over(everything)).alias("__then"),
    )
    firsts = done.where("__kind = 1").select(F.col("__part").alias("__then"), F.col("__text").alias("__next"))
    pairs = done.where("__kind = 2").select("__part", id_col, "__text").join(follows, "__part").join(firsts, "__then")
    rest = arrow_map(pairs.select(id_col, "__text", "__next"), last, f"`{id_col}` {kind}, {_RESULT}")
    return done.where("__kind = 0").select(*names[:7]).unionByName(rest)
