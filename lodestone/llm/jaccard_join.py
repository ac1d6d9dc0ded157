"""N-gram Jaccard join: size-aware, heavy and light sets, exact components.

A document's set holds the hashes (64 bits) of its distinct five-word shingles. Two
documents link when 100 * |A n B| >= 75 * |A u B|. The result gives every document its
set's size and the smallest id that links reach.

The join works on distinct sets (equal sets are one by a 128-bit digest):

1. Candidates. In one global order, rarest first, two linked sets share an element among
   their first s - ceil(3s/4) + 1, and two elements among one more. Small sets (size up
   to a boundary) are indexed by all two-element subsets of that longer prefix; larger
   ones are found by scanning the inverted lists of their prefix elements, on which the
   small sets stand that are large enough to link with them. The boundary is the one of
   least cost: subsets to enumerate against lists to scan, from the sizes and list
   lengths of the given sets.
   The order (how common an element's words are, and whether it is a frequent shingle)
   comes from counts over all documents. It only affects speed: any order is exact.
2. Filter. Each set has a parity bitmap of one bit per element or more; two sets differ
   in at least as many elements as their bitmaps in bits, so most chance candidates go,
   and no link does. Short lists give their pairs. Of long lists (of frequent shingles
   or large groups of near copies) only spanning edges of the filter's graph leave a task.
3. Exact check. Components of what passed hold every link. Their members' texts meet, all
   intersections are counted, and spanning edges of the real links give the final components.

Large groups (in 2 and 3) are cut by size into blocks of bounded weight. One block of each
is compared with all its others first; what that connects needs no more comparisons inside
it, so only members outside the largest component so found are compared with the rest. A
group of near copies of M members so costs about 2 M rows; one of which R members stay
apart costs R * M / block more. No pair table of a group is ever written.

Null and empty texts have no set (size 0) and link with nothing. Repeated rows and rows
with equal texts are linked. A null id is not a candidate for ``component_id`` unless
all ids of the component are null. Very long texts are compared whole (a set larger than a
block is a block of its own). Columns other than id and text are ignored (``keep_one_of_each``
keeps them, whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, in_tasks, sliced, stored, text_or_empty, whole_row
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import Shingled, WordHashes, mixed

#: Link when LINK[1] * intersection >= LINK[0] * union.
LINK = (3, 4)
#: Lists up to this length give all their pairs.
SHORT_LIST = 16
#: Members of a long list, and elements of sets, that are compared at once.
LIST_BLOCK = 4096
SET_BLOCK = 1_000_000
MEMBER_BLOCK = 2048
#: Entries of the tables of frequent shingles and words; they are broadcast (order only).
TABLE_ROWS = 1 << 19
FREQUENT = 16
#: Elements that a task counts at once for those tables.
COUNT_BLOCK = 1_500_000
_SIZES = 256


def prefix_length(size: int, shared: int = 1) -> int:
    """Length of the prefix in which linked sets share ``shared`` elements."""
    return min(size, size - -(-LINK[0] * size // LINK[1]) + shared)


def can_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return LINK[1] * np.minimum(a, b) >= LINK[0] * np.maximum(a, b)


def parity_bitmap(own: np.ndarray) -> bytes:
    """Bit i: whether an odd number of elements fall into bucket i (by their top bits)."""
    bits = max(9, int(len(own) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bits) folded to ``width`` bits: neighbours are added modulo 2."""
    while bitmap.shape[1] > width:
        bitmap = bitmap[:, 0::2] ^ bitmap[:, 1::2]
    return bitmap


def may_differ(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """The most elements in which linked sets of these sizes differ."""
    return (sizes_a + sizes_b) * (LINK[1] - LINK[0]) // (LINK[1] + LINK[0])


def _groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; the input is sorted by the key column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        cuts = [0, *(np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        if held and held[-1].column(key)[0].as_py() != column[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def describe_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Kind 0: one row per document; 1 and 2: counts of shingles and of words; 3: list statistics."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, words, held, types = WordHashes(), [], [], 0, []
        names = ["kind", id_col, "text_key", "size", "digest", "bitmap", "key", "n"]

        def counts() -> Iterator[pa.RecordBatch]:
            every, often = np.unique(np.concatenate(sets), return_counts=True)
            vocabulary, uses = np.unique(np.concatenate(words), return_counts=True)
            common = uses >= max(3, uses.sum() // 50_000)
            stats = np.array([int((often * (often - 1)).sum()), int(often.sum())], dtype=np.int64)
            for kind, key, n in (
                (1, every[often >= 3], often[often >= 3]),
                (2, vocabulary[common], uses[common]),
                (3, np.array([0, 1], dtype=np.uint64), stats),
            ):
                m = len(key)
                empty = [pa.nulls(m, t) for t in types]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), *empty, _long(key), _long(n)], names=names)

        for batch in (part for whole in batches for part in sliced(whole, 2, 500)):
            block = Shingled(batch.column(2).to_pylist(), hashes)
            size, digest, bitmap = [], [], []
            for k in range(batch.num_rows):
                own = block.set_of(k)
                size.append(len(own))
                digest.append(_digest(own).hex() if len(own) else None)
                bitmap.append(parity_bitmap(own) if len(own) else None)
                sets.append(own)
            words.append(block.words)
            held += sum(size)
            m = batch.num_rows
            arrays = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(bitmap, pa.binary())]
            types = [a.type for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), *arrays, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
            if held > COUNT_BLOCK:
                yield from counts()
                sets, words, held = [], [], 0
        if held:
            yield from counts()

    text = text_or_empty(text_col)
    return arrow_map(
        docs.select(F.col(id_col), F.xxhash64(text).alias("text_key"), text.alias("text")),
        run,
        f"kind int, `{id_col}` {id_type}, text_key long, size long, digest string, bitmap binary, key long, n long",
    )


def _table(described: DataFrame, kind: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys, sorted, with their counts: at most ``TABLE_ROWS``."""
    found = (
        described.where(f"kind = {kind}").groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {least}")
        .orderBy(F.desc("n"), "key").limit(TABLE_ROWS).toPandas()
    )
    keys, counts = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def choose_boundary(histogram: dict[int, int], scanned: float) -> int:
    """The size up to which subsets are enumerated, by least cost.

    A subset costs one row; a prefix element costs its row and the ``scanned`` others
    that stand on its list on average.
    """
    def cost(x: int) -> float:
        total = 0.0
        for size, n in histogram.items():
            longer = prefix_length(size, 2)
            if size <= x:
                total += n * longer * (longer - 1) / 2
            if LINK[1] * size > LINK[0] * x:
                total += n * prefix_length(size) * (1 + scanned)
        return total

    return min(range(2, 65), key=cost)


def _postings(docs: DataFrame, text_col: str, order, boundary: int) -> DataFrame:
    """``key, sid, size``: where each distinct set stands. Sizes are negative on subset keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes, common, scores = order.value
        hashes, seen = WordHashes(), set()
        for batch in (part for whole in batches for part in sliced(whole, 0, 500)):
            block = Shingled(batch.column(0).to_pylist(), hashes)
            word_scores = _looked_up(common, scores, block.words)
            keys, sids, sizes = [], [], []
            if len(seen) > 200_000:
                seen.clear()
            for k in range(batch.num_rows):
                own, score = block.set_with_scores(k, word_scores)
                size = len(own)
                if size < 3:
                    continue  # links with equal sets only
                sid = int.from_bytes(_digest(own)[:8], "big")
                if sid in seen:
                    continue
                seen.add(sid)
                rank = _looked_up(frequent, classes, own).astype(np.uint64) << np.uint64(58)
                rank |= np.minimum(score, 255).astype(np.uint64) << np.uint64(50)
                rank |= own >> np.uint64(14)
                ordered = own[np.argsort(rank, kind="stable")[: prefix_length(size, 2)]]
                mine = []
                if size <= boundary:
                    i, j = np.triu_indices(len(ordered), 1)
                    low, high = np.minimum(ordered[i], ordered[j]), np.maximum(ordered[i], ordered[j])
                    mine.append((mixed(low * np.uint64(3) + high), -size))
                if LINK[1] * size > LINK[0] * boundary:
                    mine.append((ordered[: prefix_length(size)], size))
                for key, mark in mine:
                    keys.append(key)
                    sids.append(np.full(len(key), sid, dtype=np.uint64))
                    sizes.append(np.full(len(key), mark, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [_long(np.concatenate(keys)), _long(np.concatenate(sids)), pa.array(np.concatenate(sizes))],
                    names=["key", "sid", "size"],
                )

    return arrow_map(docs.select(text_or_empty(text_col).alias("text")), run, "key long, sid long, size int")


def _scan_lists(postings: DataFrame, boundary: int) -> DataFrame:
    """Short lists as pairs (``a, b``), long lists as members (``key, a, size``)."""

    def emitted(key: np.ndarray, sid: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid, size = key[fresh], sid[fresh], size[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(starts, append=len(key))
        left, right = [], []
        for n in range(2, SHORT_LIST + 1):
            rows = starts[lengths == n]
            if len(rows):
                i, j = np.triu_indices(n, 1)
                left.append((rows[:, None] + i).ravel())
                right.append((rows[:, None] + j).ravel())
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            plain = np.abs(size).astype(np.int64)
            ok = can_link(plain[i], plain[j]) & ((size[i] < 0) | (np.maximum(plain[i], plain[j]) > boundary))
            a, b = np.minimum(sid[i[ok]], sid[j[ok]]), np.maximum(sid[i[ok]], sid[j[ok]])
            pairs = np.unique(np.stack([a, b]), axis=1)
            n = pairs.shape[1]
            if n:
                arrays = [pa.nulls(n, pa.int64()), pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "a", "b", "size"])
        member = np.repeat(lengths > SHORT_LIST, lengths)
        if member.any():
            yield members(key[member], sid[member], size[member])

    def members(key: np.ndarray, sid: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        n = len(key)
        arrays = [pa.array(key), pa.array(sid), pa.nulls(n, pa.int64()), pa.array(np.abs(size).astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "a", "b", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        long_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(c.to_numpy() for c in batch.columns)
            if rest is not None:
                columns = tuple(np.concatenate(x) for x in zip(rest, columns, strict=True))
            if long_key is not None:
                # A long list that goes on passes through; it is never held.
                more = int(np.searchsorted(columns[0], long_key, side="right"))
                if more:
                    yield members(*(c[:more] for c in columns))
                columns = tuple(c[more:] for c in columns)
                if not len(columns[0]):
                    continue
                long_key = None
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last list may go on
            if cut:
                yield from emitted(*(c[:cut] for c in columns))
            rest = tuple(c[cut:] for c in columns)
            if len(np.unique(rest[1])) > SHORT_LIST:
                yield members(*rest)
                long_key, rest = int(rest[0][0]), None
        if rest is not None:
            yield from emitted(*rest)

    dealt = postings.repartition("key").sortWithinPartitions("key", "sid")
    return arrow_map(dealt, run, "key long, a long, b long, size long")


def _cut(members: DataFrame, limit: int, weight: str) -> DataFrame:
    """``grp, a, size, block``: groups cut in the order of sizes into blocks of about ``limit`` weight.

    The cuts come from counts by group and size, so no task gathers a group. A size that
    alone makes up much of a block is dealt over blocks of its own by hash.
    """
    smaller = Window.partitionBy("grp").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        members.groupBy("grp", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("weight", F.col("n") * F.expr(weight))
        .withColumn("first", F.floor(F.coalesce(F.sum("weight").over(smaller), F.lit(0)) / limit))
        .withColumn("own", F.when(F.col("weight") > limit / 4, F.ceil(F.col("weight") / limit)))
        .select("grp", "size", "first", "own")
    )
    within = F.coalesce(F.pmod(F.xxhash64("a"), F.col("own")) + 1, F.lit(0))
    block = F.col("first") * (1 << 20) + within
    return members.join(sizes.hint("merge"), ["grp", "size"]).select("grp", "a", "size", block.alias("block"))


def _bounds(cut: DataFrame) -> DataFrame:
    return cut.groupBy("grp", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``grp, block, block2`` of every two blocks of a group whose sizes can link."""
    other = right.select("grp", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    fits = (LINK[1] * F.col("high") >= LINK[0] * F.col("low2")) & (LINK[1] * F.col("high2") >= LINK[0] * F.col("low"))
    return left.join(other, "grp").where(fits).select("grp", "block", "block2")


def _once(pairs: DataFrame, of: str) -> DataFrame:
    """Without pairs of a block and itself, if it is compared with itself in a pair with another."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("grp", of)) == 1
    return pairs.withColumn("alone", alone).where("block <> block2 or alone").drop("alone")


def _parts(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """``part, a, size``: in each part all members of the two blocks of a pair."""
    both = F.explode(F.array_distinct(F.array("block", "block2")))
    needed = pairs.select("grp", F.xxhash64("grp", "block", "block2").alias("part"), both.alias("block"))
    return cut.join(needed, ["grp", "block"]).select("part", "a", "size")


def _connected(members: DataFrame, limit: int, weight: str, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b``: edges that connect whatever ``edges_of`` links inside the groups of ``members (grp, a, size)``.

    ``edges_of`` takes parts (``part, a, size``) and gives spanning edges of each.
    """
    n = members.count()
    cut = stored(in_tasks(_cut(members, limit, weight), n), "blocks")
    bounds = stored(in_tasks(_bounds(cut), n), "block-bounds")
    # The middle block of each group meets all others.
    pivots = bounds.groupBy("grp").agg(F.percentile_approx("block", 0.5).alias("block"), F.count(F.lit(1)).alias("blocks"))
    pivots = stored(in_tasks(pivots, n), "pivots")
    first = _pairs(bounds, bounds.join(pivots.select("grp", "block"), ["grp", "block"]))
    edges = stored(edges_of(_parts(cut, _once(first, "block2"))), "block-edges")
    large = pivots.where("blocks > 1")
    if large.isEmpty():
        return edges
    labels = stored(in_tasks(connected_components(edges).withColumnRenamed("node", "a"), n), "block-components")
    stars = labels.where("a <> label").select("a", F.col("label").alias("b"))
    named = cut.join(large.select("grp", F.col("block").alias("pivot")), "grp").join(labels.hint("merge"), "a", "left")
    named = stored(in_tasks(named.select("grp", "a", "size", "block", "pivot", "label"), n), "block-labels")
    counted = named.where("label is not null").groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    placed = named.join(main, "grp", "left").where("block <> pivot")  # the pivots have met all
    inside = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    rest = _cut(placed.where(~inside).select("grp", "a", "size"), limit, weight).withColumn("block", -1 - F.col("block"))
    again = stored(in_tasks(rest.unionByName(placed.where(inside).select("grp", "a", "size", "block")), n), "blocks")
    bounds = stored(in_tasks(_bounds(again), n), "block-bounds")
    apart = bounds.where("block < 0")
    pairs = _pairs(apart, bounds).where("block2 >= 0 or block >= block2")
    return stars.unionByName(edges_of(_parts(again, _once(pairs, "block"))))


def _bits(bitmaps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bitmaps), dtype=np.uint8)).reshape(len(bitmaps), -1)


def _words64(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def bitmaps_pass(left: list[bytes], right: list[bytes], size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether each pair differs in no more bits than linked sets may differ in elements."""
    out = np.zeros(len(left), dtype=bool)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        shapes.setdefault((len(x), len(y)), []).append(k)
    allowed = may_differ(size_a, size_b)
    for (n, m), rows in shapes.items():
        width = 8 * min(n, m)
        x = _words64(folded(_bits([left[k] for k in rows]), width))
        y = _words64(folded(_bits([right[k] for k in rows]), width))
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1) <= allowed[rows]
    return out


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric boolean matrix connects: one from each member to the first of its component."""
    n, edges = len(links), []
    waiting = np.ones(n, dtype=bool)
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue:
            k = queue.pop()
            found = np.flatnonzero(links[k] & waiting)
            waiting[found] = False
            edges += [(root, int(f)) for f in found]
            queue += found.tolist()
    return edges


def _long_list_edges(parts: DataFrame) -> DataFrame:
    """``a, b``: spanning edges of the bitmap filter's graph in each part (``part, a, size, bitmap``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            sid, size = group["a"].to_numpy(), group["size"].to_numpy()
            maps = group["bitmap"].to_pylist()
            links = np.zeros((len(sid), len(sid)), dtype=bool)
            by_width: dict[int, np.ndarray] = {}
            widths = np.array([8 * len(m) for m in maps])
            for width in np.unique(widths):
                # Sets of this width against narrower or equally wide ones, at the narrower width.
                for other in np.unique(widths[widths <= width]):
                    i, j = np.flatnonzero(widths == width), np.flatnonzero(widths == other)
                    x = _words64(folded(_bits([maps[k] for k in i]), int(other)))
                    y = by_width.setdefault(int(other), _words64(_bits([maps[k] for k in j])))
                    for row, k in enumerate(i.tolist()):
                        near = np.flatnonzero(can_link(size[k], size[j]))
                        apart = np.bitwise_count(x[row] ^ y[near]).sum(axis=1)
                        ok = j[near[apart <= may_differ(size[k], size[j[near]])]]
                        links[k, ok] = True
            links |= links.T
            np.fill_diagonal(links, False)
            if edges := spanning(links):
                i, j = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(sid[i]), pa.array(sid[j])], names=["a", "b"])

    return arrow_map(parts.repartition("part").sortWithinPartitions("part"), run, "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(starts, append=len(values))
    out = np.zeros((n, n), dtype=np.float32)
    rare = min(8, n)
    for m in range(2, rare + 1):
        rows = starts[lengths == m]
        if len(rows):
            i, j = np.triu_indices(m, 1)
            np.add.at(out, (owner[(rows[:, None] + i).ravel()], owner[(rows[:, None] + j).ravel()]), 1)
    out += out.T
    dense = np.flatnonzero(lengths > rare)
    step = max(1, 16_000_000 // n)
    for at in range(0, len(dense), step):
        some = dense[at : at + step]
        columns = np.repeat(np.arange(len(some)), lengths[some])
        places = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(lengths[some])[:-1]]), lengths[some]) + np.arange(lengths[some].sum())
        table = np.zeros((n, len(some)), dtype=np.float32)
        table[owner[places], columns] = 1
        out += table @ table.T
    return out


def _exact_edges(parts: DataFrame) -> DataFrame:
    """``a, b``: spanning edges of the real links in each part (``part, digest, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in _groups(batches):
            first = dict(zip(reversed(group["digest"].to_pylist()), reversed(group["text"].to_pylist()), strict=True))
            if len(first) < 2:
                continue
            names = list(first)
            block = Shingled(list(first.values()), hashes)
            sets = [block.set_of(k) for k in range(len(names))]
            size = np.array([len(s) for s in sets], dtype=np.float32)
            both = intersections(sets)
            links = LINK[1] * both >= LINK[0] * (size[:, None] + size - both)
            np.fill_diagonal(links, False)
            if edges := spanning(links):
                i, j = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in i]), pa.array([names[k] for k in j])], names=["a", "b"])

    return arrow_map(parts.repartition("part").sortWithinPartitions("part"), run, "a string, b string")


def candidate_edges(docs: DataFrame, described: DataFrame, sets: DataFrame, text_col: str) -> DataFrame:
    """``a, b`` (long set ids): edges that connect whatever could be linked."""
    spark = docs.sparkSession
    frequent, often = _table(described, 1, FREQUENT)
    common, uses = _table(described, 2, 1)
    classes = np.array([int(c).bit_length() for c in often], dtype=np.int64)
    shares = np.log2(np.maximum(uses / max(1, uses.sum()) * (1 << 17), 1))
    order = spark.sparkContext.broadcast((frequent, np.minimum(classes, 63), common, np.minimum(2 * shares, 50).astype(np.int64)))
    stats = dict(described.where("kind = 3").groupBy("key").agg(F.sum("n")).collect())
    histogram = dict(
        sets.groupBy(F.least("size", F.lit(_SIZES)).cast("int").alias("size")).agg(F.count(F.lit(1))).collect()
    )
    boundary = choose_boundary(histogram, stats.get(0, 0) / max(1, stats.get(1, 1)))
    scanned = stored(_scan_lists(_postings(docs, text_col, order, boundary), boundary), "lists")
    marks = sets.select("sid", "size", "bitmap")

    pairs = scanned.where("b is not null").select("a", "b").distinct()
    left = marks.select(F.col("sid").alias("a"), F.col("size").alias("size_a"), F.col("bitmap").alias("map_a"))
    right = marks.select(F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("bitmap").alias("map_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 5000) for whole in batches for at in range(0, whole.num_rows, 5000)):
            ok = bitmaps_pass(b["map_a"].to_pylist(), b["map_b"].to_pylist(), b["size_a"].to_numpy(), b["size_b"].to_numpy())
            yield b.select(["a", "b"]).filter(pa.array(ok))

    # Both sides of these joins grow with the documents: sort-merge at every size.
    marked = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "size_a", "size_b", "map_a", "map_b")
    short = arrow_map(in_tasks(marked, scanned.where("b is not null").count()), keep, "a long, b long")
    members = scanned.where("b is null").select(F.col("key").alias("grp"), "a", "size")
    maps = marks.select(F.col("sid").alias("a"), "bitmap").hint("merge")
    long = _connected(
        members, LIST_BLOCK // 2, "1", lambda parts: _long_list_edges(parts.join(maps, "a").select("part", "a", "size", "bitmap"))
    )
    return stored(short.unionByName(long), "candidates")


def _rows_by_component(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_key, size, component`` of every row, stored; no component without words."""
    described = stored(describe_sets(docs, id_col, text_col), "sets")
    rows = described.where("kind = 0").select(F.col(id_col).alias("id"), "text_key", "size", "digest")
    sid = F.conv(F.substring("digest", 1, 16), 16, -10).cast("long")
    sets = stored(
        described.where("kind = 0 and size >= 3")
        .groupBy("digest")
        .agg(F.min("size").alias("size"), F.min("bitmap").alias("bitmap"), F.min(F.struct(F.col(id_col).alias("i"), "text_key")).alias("first"))
        .withColumn("sid", sid),
        "distinct-sets",
    )
    clusters = connected_components(candidate_edges(docs, described, sets, text_col))
    # Two sets may have one sid; the exact check tells them apart by their digests.
    members = sets.join(clusters.hint("merge"), sets["sid"] == clusters["node"]).select(
        F.col("label").alias("grp"), F.col("digest").alias("a"), "size", F.col("first.i").alias("__id"), F.col("first.text_key").alias("__text")
    )
    members = stored(in_tasks(members, sets.count()), "members")
    text = text_or_empty(text_col)
    wanted = members.select(F.col("a"), "__id", "__text")
    texts = docs.select(F.col(id_col).alias("__own"), text.alias("text")).withColumn("__key", F.xxhash64("text"))
    # Stored: blocks are compared in two steps, and the texts of all documents are to be shuffled for one of them only.
    found = stored(
        texts.join(wanted.hint("merge"), (F.col("__key") == F.col("__text")) & F.col("__own").eqNullSafe(F.col("__id"))).select("a", "text"),
        "member-texts",
    )
    weight = f"greatest(size, {SET_BLOCK // MEMBER_BLOCK})"
    edges = _connected(
        members.select("grp", "a", "size"),
        SET_BLOCK // 2,
        weight,
        lambda parts: _exact_edges(parts.join(found.hint("merge"), "a").select("part", F.col("a").alias("digest"), "text")),
    )
    labels = connected_components(stored(edges, "links"))
    keyed = rows.join(labels.hint("merge"), rows["digest"] == labels["node"], "left").select(
        "id", "text_key", "size", F.coalesce("label", "digest").alias("component")
    )
    return stored(in_tasks(keyed, rows.count()), "keyed")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row."""
    rows = _rows_by_component(docs, id_col, text_col)
    least = stored(rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least")), "least")
    return rows.join(least, "component", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns; documents without words stay.

    The one with the smallest id stays (a null id only where all are null; of equal ids
    the one with the smallest hash of its text). Rows are told apart by id and text, so rows
    of one id that are not linked are decided each by itself. Of rows that are equal in both
    one stays.
    """
    rows = _rows_by_component(docs, id_col, text_col).where("component is not null")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    first = stored(rows.groupBy("component").agg(F.min(order).alias("first")), "first-rows")
    stay = first.select(F.col("first.id").alias("stay_id"), F.col("first.text_key").alias("stay_key"))
    text = text_or_empty(text_col)
    keys = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    kept = keys.where("words").join(
        stay.hint("merge"), (F.col("key") == F.col("stay_key")) & F.col("id").eqNullSafe(F.col("stay_id"))
    )
    same = rows.join(first, "component").where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key")))
    if not same.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        nth = Window.partitionBy("stay_key", "stay_id").orderBy(F.lit(1))
        kept = kept.withColumn("nth", F.row_number().over(nth)).where("nth = 1")
    return keys.where(~F.col("words")).select("row.*").unionByName(kept.select("row.*"))
