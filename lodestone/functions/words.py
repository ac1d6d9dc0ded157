"""Words of plain texts (``text.is_plain``) and their indices, for a whole batch at once.

The same words as ``text.terms`` and the same indices as ``text.term_index``, found on the bytes of a batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Which characters below 2 ** 16 belong to words: letters, numbers and ``_``; of bytes those that are such a character.
_LETTER = np.array([chr(c).isalnum() or chr(c) == "_" for c in range(1 << 16)])
_BYTE = np.arange(256) < 128
_BYTE &= _LETTER[:256]
#: The table of CRC-32, by what a state becomes by one byte.
_CRC = np.array([zlib.crc32(bytes([k ^ 255])) ^ 0xFF000000 for k in range(256)], np.uint32)
#: Words up to so many bytes have their indices worked out side by side.
SHORT = 64


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text, and all bytes that they are bounds in."""
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of plain texts one after the other, with the place of the text that each is from. A null text has none."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    at, data = _bytes(pc.utf8_lower(texts.cast(pa.string()).fill_null("")))
    data = data[: at[-1]]
    inside = _BYTE[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        # No plain character has more than three bytes.
        first, second, three = data[lead].astype(np.int32), data[lead + 1] & 63, data[lead] >= 0xE0
        third = data[np.minimum(lead + 2, len(data) - 1)] & 63
        of_word = _LETTER[np.where(three, (first & 15) << 12 | second.astype(np.int32) << 6 | third, (first & 31) << 6 | second)]
        hit, longer = lead[of_word], lead[of_word & three]
        inside[hit] = inside[hit + 1] = inside[longer + 2] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    begins[starts] = inside[starts]
    first = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int32)
    bounds = np.append(kept[first] - 1, kept[-1:]).astype(np.int32) if len(first) else np.zeros(1, np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    return np.searchsorted(at, first, side="right") - 1, words


def word_indices(words: pa.Array) -> np.ndarray:
    """``text.term_index`` of each word."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.string())
    at, data = _bytes(words)
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    start, lengths = at[:-1][order], length[order]
    many = np.searchsorted(-lengths, -SHORT)
    state = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths[many]) if many < len(words) else 0):
        some = slice(many, np.searchsorted(-lengths, -k))
        state[some] = _CRC[(state[some] ^ data[start[some] + k]) & 255] ^ state[some] >> 8
    found = np.empty(len(words), np.int64)
    found[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:many]:
        found[k] = zlib.crc32(data[at[k] : at[k + 1]])
    return found
