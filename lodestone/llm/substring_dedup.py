"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash of the last eight code points is computed at every place; a chunk ends
where it is greater than at all places up to ``RADIUS`` before and not less than at
those after. Ends depend on nearby characters only, so an insertion moves chunks but
does not change those beside it. Chunks are ``2 * RADIUS + 1`` code points long on
average and at least ``RADIUS``, but for the first and last of a text.

A chunk is repeated if its 64-bit digest (with its length) occurs in documents of
different ids. The document with the smallest id keeps it. In the others, unbroken runs
of repeated chunks of at least ``min_chars`` code points are duplicates: a passage of
over 50 words gives one, whatever stands around it (what it loses at its ends is less
than two chunks); a chance match of one chunk does not. A run comes as spans, one for each
stretch that the keeping document has in one piece: the text of a span stands in the
document ``first_id`` from ``first_start`` on. Runs inside one document only are not
duplicates.

Null and empty texts have no chunks. Rows of equal id count as one document; a null id
(of any type) is an id of its own that is smaller than all others. A text without any
maximum (one character over and over) is one chunk. Very long texts are cut whole. An empty
table gives an empty result; columns other than id and text are ignored
(``without_duplicate_spans`` keeps them, whatever their names).

Digests are aggregated with partial minima and maxima, so a line that a third of all
documents share costs one row per task; the join back needs no whole groups, so Spark
splits hot digests. Runs are windows over one document's chunks. The texts are cut twice, for
the digests and for the join: that takes less than to store and read all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, stored, text_or_empty, whole_row

RADIUS = 16
WINDOW = 8
#: Least length of a run, in code points: about 20 words of typical length.
MIN_CHARS = 96
#: Code points that are hashed at once (a longer text is hashed alone).
BLOCK_CHARS = 1_000_000
_TABLE = 1 << 12
_GEAR = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 32, _TABLE, dtype=np.uint32)
_DIGEST = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, _TABLE, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p)


def chunk_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end, digest)`` of every chunk of every text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    gap = RADIUS + WINDOW
    data = np.frombuffer(("\0" * gap + ("\0" * gap).join(texts) + "\0" * gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = gap + np.concatenate([[0], np.cumsum(lengths + gap)[:-1]]).astype(np.int64)
    edges = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    inside = np.cumsum(edges[:-1]) > 0
    row = (data ^ data >> np.uint32(12)) % np.uint32(_TABLE)
    h = np.where(inside, _GEAR[row], np.uint32(0))
    for width in (1, 2, 4):
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(width))
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x45D9F3B)
    h = np.where(inside, h ^ h >> np.uint32(15), np.uint32(0))
    # Greatest value over the RADIUS places before, and over those after.
    top, width = h, 1
    while width < RADIUS:
        more = np.zeros_like(top)
        more[width:] = top[:-width]
        top = np.maximum(top, more)
        width *= 2
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[1:] = top[:-1]
    after[: len(h) - RADIUS] = top[RADIUS:]
    cut = inside & (h > before) & (h >= after)
    full = np.flatnonzero(lengths)
    cut[starts[full] + lengths[full] - 1] = True
    ends = np.flatnonzero(cut) + 1
    owner = np.searchsorted(starts, ends - 1, side="right") - 1
    begin = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=bool)
    begin = np.where(first, starts[owner], begin[: len(owner)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_DIGEST[row] + data) * _powers(_STEP, len(data)))])
    digest = (sums[ends] - sums[begin]) * _powers(pow(_STEP, -1, 1 << 64), len(data))[begin]
    digest += (ends - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    digest = (digest ^ digest >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    digest ^= digest >> np.uint64(29)
    return owner, begin - starts[owner], ends - starts[owner], digest


def text_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, part, start, end, digest``: the chunks of all texts; ``part`` tells rows of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            lengths = np.cumsum(pa.compute.utf8_length(whole.column(2)).to_numpy(zero_copy_only=False))
            while at < whole.num_rows:
                done = lengths[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(lengths, done + BLOCK_CHARS, side="right")))
                batch = whole.slice(at, stop - at)
                at = stop
                owner, start, end, digest = chunk_texts(batch.column(2).to_pylist())
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(digest.view(np.int64))],
                    names=[id_col, "part", "start", "end", "digest"],
                )

    text = text_or_empty(text_col)
    return arrow_map(
        docs.select(F.col(id_col), F.hash(text).alias("part"), text.alias("text")), run, f"`{id_col}` {kind}, part int, start int, end int, digest long"
    )


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, part, start, end, n_chunks, first_id, first_start``: spans that a document with a smaller id keeps."""
    # A struct that tells null ids apart orders them first, whatever the id's type.
    doc = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"))
    chunks = text_chunks(docs, id_col, text_col).select(doc.alias("doc"), "part", "start", "end", "digest")
    repeated = stored(
        chunks.groupBy("digest")
        .agg(F.min(F.struct("doc", "part", "start")).alias("first"), F.max("doc").alias("last"))
        .where("first.doc <> last")
        .select("digest", "first"),
        "repeated-chunks",
    )
    # The repeated digests grow with the documents: sort-merge at every size.
    found = chunks.join(repeated.hint("merge"), "digest").where("doc <> first.doc")
    # Where the keeping document has it: chunks that follow each other there share all three.
    source = F.struct("first.doc", "first.part", (F.col("start") - F.col("first.start")).alias("shift"))
    of_text = Window.partitionBy("doc", "part").orderBy("start")
    so_far = of_text.rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        found.select("doc", "part", "start", "end", source.alias("source"))
        .withColumn("last", F.lag(F.struct("start", "end", "source")).over(of_text))
        .where(F.col("last").isNull() | (F.col("last.start") != F.col("start")))  # a repeated row counts once
        .withColumn("gap", F.coalesce(F.col("start") != F.col("last.end"), F.lit(True)))
        .withColumn("run", F.sum(F.col("gap").cast("int")).over(so_far))
        .withColumn("piece", F.sum((F.col("gap") | (F.col("source") != F.col("last.source"))).cast("int")).over(so_far))
        .groupBy("doc", "part", "run", "piece")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.min("source").alias("source"))
        .withColumn("chars", F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("doc", "part", "run")))
        .where(F.col("chars") >= min_chars)
    )
    return spans.select(
        F.col("doc.id").alias(id_col), "part", "start", "end", "n_chunks",
        F.col("source.doc.id").alias("first_id"), (F.col("start") - F.col("source.shift")).alias("first_start"),
    )


def without_duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the duplicate spans cut out of their texts."""
    spans = stored(duplicate_spans(docs, id_col, text_col), "duplicate-spans")
    of_text = spans.groupBy(F.col(id_col).alias("span_id"), F.col("part").alias("span_part")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    text = F.col("plain")
    # Each span is followed by what stands up to the next one.
    kept = F.transform(
        "spans",
        lambda s, k: F.substring(text, s["end"] + 1, F.coalesce(F.get("spans", k + 1)["start"], F.length(text)) - s["end"]),
    )
    rest = F.concat(F.substring(text, F.lit(1), F.get("spans", F.lit(0))["start"]), F.array_join(kept, ""))
    plain = text_or_empty(text_col)
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), plain.alias("plain"), F.hash(plain).alias("hash"))
    joined = rows.join(of_text, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("hash") == F.col("span_part")), "left")
    own = F.col("row")[text_col]
    return joined.select(
        *[(F.when(F.col("spans").isNotNull(), rest).otherwise(own) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    )
