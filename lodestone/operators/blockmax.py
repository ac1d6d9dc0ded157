"""BM25 search over stored postings with block-max pruning; same rows as ``bm25.sparse_topk``.

Chunks are dealt into shards by a hash of their id and numbered within by length (chunks of like length
have like weights, so bounds are close); ``BLOCK`` neighbours are a block. The stored postings have one row per shard, term and block: the chunks' places, their
weights, and the greatest weight. For a question the greatest weights bound the score of any chunk of
a block. In each shard blocks are scored from the highest bound on, until it falls below the
k-th best score so far, so most postings of common terms are never scored. A shard has
``SHARD_CHUNKS`` chunks on average, so a task holds the asked terms' rows of one shard at a time, whatever
the size of the corpus; every shard passes on its own k best.

Document frequencies are taken from a table that the caller keeps (see ``build.index_frequencies``) or
counted on the postings. Scores are rounded before they are compared and ties go by chunk id, as
in ``bm25``; bounds leave room for the rounding, so a tie is never cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.bm25 import MAX_ASKED, K1, B, frequencies as counted, packed, question_terms, ranked
from lodestone.sources.tables import materialised

BLOCK, SHARD_CHUNKS = 32, 1 << 14
ROOM = 1e-8


@dataclass
class BlockPostings:
    """``rows``: ``shard, term_index, block, most, places, weights``; ``chunks``: ``shard, place, chunk_id``; ``idf``: ``term_index, idf``."""

    rows: DataFrame
    chunks: DataFrame
    idf: DataFrame


STORED = "kind string, shard int, term_index long, block int, most double, places array<int>, weights array<double>, chunk_ids array<string>"


def _stored_rows(number: int, table: pa.Table, avgdl: float) -> list[pa.RecordBatch]:
    """One shard, its chunks by length: a row per term and block, and a row with the ids of all chunks in their places."""
    entries = table["entries"].combine_chunks()
    place = np.repeat(np.arange(len(entries)), entries.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
    term, tf = (c.to_numpy(zero_copy_only=False) for c in entries.flatten().flatten())
    dl = table["dl"].to_numpy()[place]
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    order = np.argsort(term, kind="stable")  # places ascend within a term
    term, place, weight = term[order], place[order], weight[order]
    first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(place // BLOCK, prepend=-1) != 0))
    bounds = pa.array(np.append(first, len(term)).astype(np.int32))
    n = len(first)
    most = np.maximum.reduceat(weight, first) if n else np.empty(0)
    ids = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["chunk_id"].combine_chunks())
    names = [c.split()[0] for c in STORED.split(", ")]
    blocks = [
        pa.array(["blocks"] * n, pa.string()), pa.array([number] * n, pa.int32()), pa.array(term[first], pa.int64()), pa.array(place[first] // BLOCK, pa.int32()),
        pa.array(most), pa.ListArray.from_arrays(bounds, pa.array(place)), pa.ListArray.from_arrays(bounds, pa.array(weight)), pa.nulls(n, pa.list_(pa.string())),
    ]
    types = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
    chunks = [pa.array(["chunks"]), pa.array([number], pa.int32()), *[pa.nulls(1, t) for t in types], ids.cast(pa.list_(pa.string()))]
    return [pa.RecordBatch.from_arrays(cells, names=names) for cells in (blocks, chunks)]


def build_blocks(postings: DataFrame, stats: DataFrame, path: str, frequencies: DataFrame | None = None) -> BlockPostings:
    """Stores postings (packed, or ``chunk_id, term_index, tf, dl``) by shard at ``path``.

    ``stats``: one row ``n_chunks, avgdl``; ``frequencies``: ``term_index, n``, if they are kept. Packed postings
    are shuffled once, by shard, and a task makes the blocks of one shard at a time.
    """
    spark = postings.sparkSession
    n_chunks, avgdl = stats.select("n_chunks", "avgdl").first()
    shards = max(1, -(-n_chunks // SHARD_CHUNKS))
    own = packed(postings).where(F.size("entries") > 0)
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_shard(batches):
            for stored in _stored_rows(table["shard"][0].as_py(), table, avgdl):
                yield from (stored.slice(at, 4096) for at in range(0, stored.num_rows, 4096))

    dealt = own.select(shard, "chunk_id", "dl", "entries").repartition("shard").sortWithinPartitions("shard", "dl", "chunk_id")
    # By term within a shard, so that a search reads the row groups of the terms it asks for.
    dealt.mapInArrow(run, STORED).write.mode("overwrite").partitionBy("kind", "shard").parquet(f"{path}/shards")
    df = frequencies if frequencies is not None else counted(postings)
    idf = F.log1p((F.lit(n_chunks) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    df.select("term_index", idf.alias("idf")).write.mode("overwrite").parquet(f"{path}/idf")
    return open_blocks(spark, path)


def open_blocks(spark: SparkSession, path: str) -> BlockPostings:
    rows = spark.read.schema(STORED).parquet(f"{path}/shards")
    return BlockPostings(
        rows.where("kind = 'blocks'").select("term_index", "block", "most", "places", "weights", "shard"),
        rows.where("kind = 'chunks'").select(F.posexplode("chunk_ids").alias("place", "chunk_id"), "shard").select("chunk_id", "place", "shard"),
        spark.read.schema("term_index long, idf double").parquet(f"{path}/idf"),
    )


class Shard:
    """The asked terms' postings of one shard, and the search in it."""

    def __init__(self, terms: np.ndarray, blocks: np.ndarray, most: np.ndarray, places: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> None:
        order = np.lexsort((blocks, terms))
        self.blocks, self.most, self.places, self.weights = blocks[order], most[order], places, weights
        self.begin, self.end = bounds[:-1][order], bounds[1:][order]
        self.terms, first = np.unique(terms[order], return_index=True)
        self.edges = np.append(first, len(order))
        self.n_blocks = int(blocks.max()) + 1
        self.scored = 0

    def rows_of(self, term: int) -> slice:
        at = int(np.searchsorted(self.terms, term))
        there = at < len(self.terms) and self.terms[at] == term
        return slice(int(self.edges[at]), int(self.edges[at + 1])) if there else slice(0, 0)

    def search(self, asked: list[tuple[int, float]], k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the chunks that may be among the k best of this shard; ties at the end are all there."""
        bound, rows = np.zeros(self.n_blocks), []
        for term, idf in asked:
            own = self.rows_of(term)
            bound[self.blocks[own]] += self.most[own] * idf
            rows.append((own, idf))
        order = np.argsort(-bound, kind="stable")
        kept_places, kept_scores, least = np.empty(0, dtype=np.int64), np.empty(0), -np.inf
        for at in range(0, len(order), 4):
            some = order[at : at + 4]
            if not bound[some[0]] > 0 or bound[some[0]] < least - ROOM:
                break
            some = some[(bound[some] > 0) & (bound[some] >= least - ROOM)]
            scores, hit = np.zeros(len(some) * BLOCK), np.zeros(len(some) * BLOCK, dtype=bool)
            for own, idf in rows:
                found = own.start + np.searchsorted(self.blocks[own], some)
                for slot, row in enumerate(found):
                    if row < own.stop and self.blocks[row] == some[slot]:
                        entry = slice(self.begin[row], self.end[row])
                        place = slot * BLOCK + self.places[entry] % BLOCK
                        scores[place] += self.weights[entry] * idf
                        hit[place] = True
                        self.scored += entry.stop - entry.start
            place = np.flatnonzero(hit)
            kept_places = np.concatenate([kept_places, some[place // BLOCK] * BLOCK + place % BLOCK])
            kept_scores = np.concatenate([kept_scores, np.round(scores[place], digits)])
            if len(kept_scores) > k:
                least = np.partition(kept_scores, len(kept_scores) - k)[len(kept_scores) - k]
                best = kept_scores >= least
                kept_places, kept_scores = kept_places[best], kept_scores[best]
            elif len(kept_scores) == k:
                least = kept_scores.min()
        return kept_places, kept_scores


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by shard as one table per shard."""
    held: list[pa.Table] = []
    for batch in batches:
        own = batch["shard"].to_numpy()
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own)) + 1):
            if not len(part):
                continue
            if held and held[0]["shard"][0].as_py() != own[part[0]]:
                yield pa.concat_tables(held).combine_chunks()
                held.clear()
            held.append(pa.Table.from_batches([batch.slice(int(part[0]), len(part))]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard, int]]:
    """Rows sorted by shard as one ``Shard`` after the other, with its number and how many postings it has."""
    for table in _by_shard(batches):
        column = lambda name: table[name].combine_chunks()  # noqa: E731, B023
        sizes = column("places").value_lengths().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        flat = [column(n).flatten().to_numpy(zero_copy_only=False) for n in ("places", "weights")]
        yield table["shard"][0].as_py(), Shard(*(table[n].to_numpy() for n in ("term_index", "block", "most")), *flat, bounds), int(bounds[-1])


def _run(questions: DataFrame, index: BlockPostings, k: int, digits: int, schema: str, report: bool) -> DataFrame:
    asked = materialised(question_terms(questions), "asked")
    of_terms = materialised(asked.join(index.idf, "term_index"), "asked-idf")
    n = of_terms.count()
    groups = max(1, -(-n // MAX_ASKED))
    parts = []
    for group in range(groups):
        # Whole questions, MAX_ASKED of their terms or so at a time; they are broadcast and so is nothing else.
        got = of_terms.where(F.pmod(F.xxhash64("question_id"), F.lit(groups)) == group).select("question_id", "term_index", "idf").toArrow()
        by_question: dict = {}
        for q, term, idf in zip(*(got[c].to_pylist() for c in ("question_id", "term_index", "idf")), strict=True):
            by_question.setdefault(q, []).append((term, idf))
        for terms_of in by_question.values():
            terms_of.sort()
        given = index.rows.sparkSession.sparkContext.broadcast(by_question)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for number, shard, there in _shards(batches):
                q, place, score, possible = [], [], [], 0
                for question, terms_of in given.value.items():
                    places, scores = shard.search(terms_of, k, digits)
                    q += [question] * len(places)
                    place.append(places)
                    score.append(scores)
                    if report:
                        rows = [shard.rows_of(t) for t, _ in terms_of]
                        possible += sum(int((shard.end[r] - shard.begin[r]).sum()) for r in rows)
                if report:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard.scored, possible)], names=["scored", "possible"])
                elif q:
                    cells = [pa.array(q), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(score)), pa.array([number] * len(q), pa.int32())]
                    yield pa.RecordBatch.from_arrays(cells, names=["question_id", "place", "score", "shard"])

        wanted = index.rows.join(F.broadcast(of_terms.select("term_index").distinct()) if n <= MAX_ASKED else of_terms.select("term_index").distinct(), "term_index", "left_semi")
        dealt = wanted.repartition("shard").sortWithinPartitions("shard")
        found = dealt.select("shard", "term_index", "block", "most", "places", "weights").mapInArrow(run, schema)
        parts.append(materialised(found, "shard-candidates") if groups > 1 else found)
        if groups > 1:
            given.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def blockmax_topk(questions: DataFrame, index: BlockPostings, k: int = 5, digits: int = 9) -> DataFrame:
    """``question_id, chunk_id, score, rank``: the k best chunks by BM25, as ``bm25.sparse_topk`` gives them."""
    q_type = questions.schema["question_id"].dataType.simpleString()
    found = _run(questions, index, k, digits, f"question_id {q_type}, place int, score double, shard int", False)
    # Each shard gives k chunks per question (and ties), so this is small beside the chunks.
    named = found.join(index.chunks, ["shard", "place"]).select("question_id", "chunk_id", "score")
    return ranked(named, k)


def postings_scored(questions: DataFrame, index: BlockPostings, k: int = 5, digits: int = 9) -> DataFrame:
    """One row ``scored, possible``: postings that a search scores, and that the asked terms have, summed over questions."""
    counts = _run(questions, index, k, digits, "scored long, possible long", True)
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scored", "possible")])
