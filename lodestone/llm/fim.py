"""Fill-in-the-middle: whole texts cut into units, rearranged by pyarrow.compute, and put back.

A unit is a word with the white space before it, or what white space is left at the end.
Per Arrow batch the units of all texts are split into list arrays, flattened with the
number of their text, numbered within it, filtered by role (prefix, middle, suffix),
rebuilt into lists and joined; no text is handled by itself. Splitting works on UTF-8 bytes:
every separator is ASCII, so bytes and code points give the same units, and the byte 0xFF,
which UTF-8 never has, marks their borders.

Where the borders lie and which form a text takes follows from the SHA-256 of ``seed:id``,
so a repeated task or another partitioning gives the same rows. A text is ``plain`` (left as it
is) if it is empty or contains one of the marks, or by its hash; else it is ``spm``
(suffix first) or ``psm``.

Nulls count as empty texts; a null id is hashed as the text ``null``. Repeated ids are cut
alike where their texts have as many units. Columns that have an output's name are replaced, all
others are kept, whatever their names. Empty tables give empty results; a very long text is
one row of one batch and is never cut. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, fields, sliced, text_or_empty

#: Marks, the seed, and the percentages of rearranged and of suffix-first texts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
BORDER = b"\xff"
OUTPUTS = {
    "n_units": "long", "form": "string", "prefix": "string", "middle": "string", "suffix": "string", "output": "string", "restored": "string",
}
HASHES = 4


def id_hashes(id_col: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id``, as unsigned numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(HASHES)]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of large binary ``texts`` in one array, and where each text's units begin (one more than texts)."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, UNIT, b"\\1" + BORDER), BORDER)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # Behind the last border stands an empty piece, which is no unit.
    real = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(pc.filter(parent, real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return pc.filter(flat, real), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _joined(flat: pa.Array, mask: np.ndarray, parent: np.ndarray, n: int) -> pa.Array:
    """The masked units of each of ``n`` texts, joined."""
    counts = np.bincount(parent[mask], minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int64())
    rebuilt = pa.LargeListArray.from_arrays(offsets, pc.filter(flat, pa.array(mask)))
    return pc.binary_join(rebuilt, pa.scalar(b"", pa.large_binary()))


def _glued(*pieces: pa.Array | str) -> pa.Array:
    as_binary = [pa.scalar(p.encode(), pa.large_binary()) if isinstance(p, str) else p for p in pieces]
    return pc.binary_join_element_wise(*as_binary, pa.scalar(b"", pa.large_binary()))


def rearranged(
    texts: pa.Array, h: list[np.ndarray], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> dict[str, pa.Array]:
    """``n_units, form, prefix, middle, suffix, output`` of large binary ``texts`` (pieces are null where plain)."""
    flat, bounds = units(texts)
    n = np.diff(bounds)
    parent = np.repeat(np.arange(len(n)), n)
    ordinal = np.arange(len(flat)) - bounds[parent]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(a, b)[parent], np.maximum(a, b)[parent]
    roles = {"prefix": ordinal < low, "middle": (ordinal >= low) & (ordinal < high), "suffix": ordinal >= high}
    piece = {role: _joined(flat, mask, parent, len(n)) for role, mask in roles.items()}
    marked = pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE)).encode()).to_numpy(zero_copy_only=False)
    plain = pa.array((n == 0) | marked | (h[2] % 100 >= fim_percent))
    spm = pa.array(h[3] % 100 < spm_percent)
    psm_text = _glued(PREFIX, piece["prefix"], SUFFIX, piece["suffix"], MIDDLE, piece["middle"])
    spm_text = _glued(SUFFIX, piece["suffix"], PREFIX, piece["prefix"], MIDDLE, piece["middle"])
    nothing = pa.scalar(None, pa.large_binary())
    return {
        "n_units": pa.array(n, pa.int64()),
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        **{role: pc.if_else(plain, nothing, p) for role, p in piece.items()},
        "output": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
    }


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts behind ``output``, from it and the form alone.

    A rearranged text has no mark of its own, so the first of each mark is the one put in.
    """

    def parsed(first: str, second: str) -> pa.Array:
        return pc.extract_regex(output, f"(?s)^{first}(?P<a>.*?){second}(?P<b>.*?){MIDDLE}(?P<m>.*)$".encode())

    psm, spm = parsed(PREFIX, SUFFIX), parsed(SUFFIX, PREFIX)
    of = pc.struct_field
    from_psm = _glued(of(psm, "a"), of(psm, "m"), of(psm, "b"))
    from_spm = _glued(of(spm, "b"), of(spm, "m"), of(spm, "a"))
    return pc.if_else(pc.equal(form, "plain"), output, pc.if_else(pc.equal(form, "spm"), from_spm, from_psm))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``docs`` without its text column, with ``n_units, form, prefix, middle, suffix, output, restored``."""
    taken = {text_col.lower(), *OUTPUTS}
    names = [c for c in docs.columns if c.lower() not in taken]
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, at):
                texts = batch.column(at).cast(pa.large_binary())
                h = [batch.column(at + 1 + i).to_numpy(zero_copy_only=False) for i in range(HASHES)]
                found = rearranged(texts, h, fim_percent, spm_percent)
                found["restored"] = restored(found["output"], found["form"])
                columns = [found[o] if o in ("n_units", "form") else found[o].cast(pa.large_string()).cast(pa.string()) for o in OUTPUTS]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names=[*names, *OUTPUTS])

    hashes = [h.alias(f"h{i}") for i, h in enumerate(id_hashes(F.col(id_col), seed))]
    # Numbered names on the way in, so that no column's name can clash with a helper's.
    given = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], text_or_empty(text_col).alias("text"), *hashes)
    kept = fields(docs, names)
    return arrow_map(given, run, ", ".join([*([kept] if kept else []), *(f"`{n}` {t}" for n, t in OUTPUTS.items())]))
