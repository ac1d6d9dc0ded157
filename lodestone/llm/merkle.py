"""Merkle manifest of a dataset, as a tree of SHA-256 midstates.

A row's leaf is the SHA-256 of its fields, each with its length. Per group (a source) the leaves
in order of their id are hashed by runs of ``ARITY``, level by level, until one node remains,
the group's subroot; subroots in order of the group are hashed likewise to one root. Inputs are
digests as hex text, of 64 bytes each: just one block of SHA-256. So the state of a parent
before each child's slot is eight words, and is kept: to fold a changed leaf upwards, the
matching state is resumed with the replacement and the siblings to its right only. The hash
of a proof (all siblings on the way) is carried upwards the same way.

Blocks of ``ARITY ** LEVELS`` neighbouring nodes are climbed at once, in numpy over many
blocks of a batch; their tops are the nodes of the next pass, so no task ever has a whole
group, and a pass has a 2187th of the rows of the one before. Rows are numbered by ranges and
their counts. What lies above a block is one path for all its rows, joined to them by block.

Null fields are hashed as ``-``. Null ids come first, rows that are equal in group and id are in
order of their leaves, repeated rows are leaves of their own; a null group is the first one. Very
long texts are hashed whole. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, stored

ARITY, LEVELS = 3, 7
BLOCK = ARITY**LEVELS
#: Fixed order of the fields in a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that one step of folding handles at once.
FOLD_ROWS = 8192
#: A level of a path: the parent's state before the node's slot, the other children, the slot, and how many children.
LEVEL = np.dtype([("state", ">u4", 8), ("others", ">u4", (ARITY - 1, 8)), ("slot", "u1"), ("children", "u1")])


def _roots(power: int, n: int) -> list[int]:
    """The first 32 bits of the fractional parts of the ``power``-th roots of the first ``n`` primes."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, int(p**0.5) + 1))][:n]
    found = []
    for p in primes:
        low, high, target = 0, 1 << 40, p << (32 * power)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if mid**power <= target else (low, mid)
        found.append(low & 0xFFFFFFFF)
    return found


#: SHA-256's first state and round constants, by their definition.
START = np.array(_roots(2, 8), dtype=np.uint32)
ROUND = np.array(_roots(3, 64), dtype=np.uint32)
HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), dtype=np.uint16)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256's step on many states ``(n, 8)`` and blocks ``(n, 16)`` of 32-bit words at once."""
    w = [np.ascontiguousarray(block[:, i]) for i in range(16)]
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(state[:, i]) for i in range(8))
    for t in range(64):
        if t >= 16:
            x, y = w[(t - 15) % 16], w[(t - 2) % 16]
            w[t % 16] = w[t % 16] + w[(t - 7) % 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3)) + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + ROUND[t] + w[t % 16]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def as_block(digests: np.ndarray) -> np.ndarray:
    """Digests ``(n, 8)`` as the words of their hex text: one block each."""
    raw = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8)
    return np.ascontiguousarray(HEX[raw]).view(np.uint8).reshape(len(digests), 64).view(">u4").astype(np.uint32)


def ended(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of states that have taken so many whole blocks."""
    last = np.zeros((len(state), 16), dtype=np.uint32)
    last[:, 0] = 0x80000000
    last[:, 14], last[:, 15] = blocks.astype(np.int64) >> 23, blocks.astype(np.int64) << 9 & 0xFFFFFFFF
    return compress(state, last)


def words(column: pa.Array) -> np.ndarray:
    """A column of 32-byte digests as ``(n, 8)`` words."""
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, dtype=">u4").reshape(-1, 8).astype(np.uint32)


def raw(digests: np.ndarray) -> pa.Array:
    data = digests.astype(">u4").tobytes()
    return pa.array([data[i : i + 32] for i in range(0, len(data), 32)], pa.binary())


def climbed(group: np.ndarray, index: np.ndarray, nodes: np.ndarray, digests: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Whole blocks climbed by up to ``LEVELS`` levels.

    ``group`` numbers the blocks, ``index`` is a node's place in its whole level, ``nodes`` is how
    many that level has; rows are in order of group and index. Gives per level the rows that have
    it with a ``LEVEL`` each, and every row's top.
    """
    at = np.arange(len(group))  # each row's node of the current level
    levels = []
    for _ in range(LEVELS):
        many = nodes > 1
        if not many.any():
            break
        parent_index = index // ARITY
        first = np.ones(len(group), dtype=bool)
        first[1:] = (group[1:] != group[:-1]) | ~many[1:] | (parent_index[1:] != parent_index[:-1])
        parent, slot = np.cumsum(first) - 1, index % ARITY
        child = np.full((parent[-1] + 1, ARITY), -1)
        child[parent[many], slot[many]] = np.flatnonzero(many)
        count = (child >= 0).sum(axis=1)
        blocks = as_block(digests)
        state = np.tile(START, (len(child), 1))
        before = np.zeros((len(child), ARITY, 8), dtype=np.uint32)
        for s in range(ARITY):
            before[:, s] = state
            there = np.flatnonzero(child[:, s] >= 0)
            state[there] = compress(state[there], blocks[child[there, s]])
        node_levels = np.zeros(len(group), dtype=LEVEL)
        node_levels["state"] = before[parent, slot]
        node_levels["slot"], node_levels["children"] = slot, count[parent]
        for k in range(ARITY - 1):
            other = child[parent, np.where(k >= slot, k + 1, k)]
            node_levels["others"][:, k] = np.where((other >= 0)[:, None], digests[other], 0)
        rows = np.flatnonzero(many[at])
        levels.append((rows, node_levels[at[rows]]))
        up = digests[first].copy()
        tree = count > 0
        up[tree] = ended(state[tree], count[tree])
        at = parent[at]
        digests, group = up, group[first]
        index = np.where(many[first], parent_index[first], index[first])
        nodes = -(-nodes[first] // ARITY)
    return levels, digests[at]


def fold(level: np.ndarray, current: np.ndarray, proof: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """One level up from ``current``: the kept state, the replacement, the siblings to the right.

    All siblings are added to the states ``proof``; ``taken`` counts them (both in place).
    """
    state = compress(level["state"].astype(np.uint32), as_block(current))
    for k in range(ARITY - 1):
        there = np.flatnonzero(level["children"] - 1 > k)
        block = as_block(level["others"][there, k])
        proof[there] = compress(proof[there], block)
        taken[there] += 1
        right = k >= level["slot"][there]
        state[there[right]] = compress(state[there[right]], block[right])
    return ended(state, level["children"])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``gid, block, idx`` in tables that never part a block; a block has ``BLOCK`` rows at most."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
        gid, block = table["gid"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
        last = len(block) - 1
        cut = np.flatnonzero((block != block[last]) | (gid != gid[last]))
        stop = int(cut[-1]) + 1 if len(cut) else 0
        if stop:
            yield table.slice(0, stop)
        held = [table.slice(stop)]
    if held:
        yield held[0]


def _groups(table: pa.Table) -> np.ndarray:
    gid, block = table["gid"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
    return np.cumsum(np.concatenate([[False], (gid[1:] != gid[:-1]) | (block[1:] != block[:-1])]))


def _blocks_of(nodes: DataFrame) -> DataFrame:
    dealt = nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))
    return dealt.repartition("gid", "block").sortWithinPartitions("gid", "block", "idx")


def _climb_leaves(leaves: DataFrame) -> DataFrame:
    """``id, gid, block, idx, n, leaf`` with the block's ``top``, the changed leaf ``folded`` to it, and the proof so far."""
    names = ("id", "gid", "block", "idx", "n", "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            levels, tops = climbed(_groups(table), table["idx"].to_numpy(), table["n"].to_numpy(), words(table["leaf"]))
            current = words(table["changed"])
            proof, taken = np.tile(START, (len(current), 1)), np.zeros(len(current), dtype=np.int64)
            for rows, level in levels:
                for at in range(0, len(rows), FOLD_ROWS):
                    some = rows[at : at + FOLD_ROWS]
                    p, t = proof[some], taken[some]
                    current[some] = fold(level[at : at + FOLD_ROWS], current[some], p, t)
                    proof[some], taken[some] = p, t
            made = [raw(tops), raw(current), raw(proof), pa.array(taken)]
            yield from pa.table([*(table[n] for n in names), *made], names=[*names, "top", "folded", "proof", "taken"]).to_batches()

    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, gid string, block long, idx long, n long, leaf binary, top binary, folded binary, proof binary, taken long"
    return arrow_map(_blocks_of(leaves).select("id", "gid", "block", "idx", "n", "leaf", "changed"), run, schema)


def _climb_nodes(nodes: DataFrame) -> DataFrame:
    """``gid, block, idx, n, path, top`` of nodes; a path is one ``LEVEL`` after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            levels, tops = climbed(_groups(table), table["idx"].to_numpy(), table["n"].to_numpy(), words(table["digest"]))
            paths = [b""] * table.num_rows
            for rows, level in levels:
                for row, one in zip(rows, level, strict=True):
                    paths[row] += one.tobytes()
            made = [pa.array(paths, pa.binary()), raw(tops)]
            yield from pa.table([*(table[c] for c in ("gid", "block", "idx", "n")), *made], names=["gid", "block", "idx", "n", "path", "top"]).to_batches()

    return arrow_map(_blocks_of(nodes).select("gid", "block", "idx", "n", "digest"), run, "gid string, block long, idx long, n long, path binary, top binary")


def paths_above(nodes: DataFrame) -> DataFrame:
    """``gid, idx, path, top`` of nodes ``gid, idx, n, digest``: the whole way up, and what remains of the group."""
    climbed_once = stored(_climb_nodes(nodes), "merkle-paths")
    if climbed_once.where(f"n > {BLOCK}").isEmpty():
        return climbed_once.select("gid", "idx", "path", "top")
    tops = climbed_once.where(f"idx % {BLOCK} = 0").select("gid", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    higher = paths_above(tops).select("gid", F.col("idx").alias("block"), F.col("path").alias("higher"), F.col("top").alias("last"))
    return climbed_once.join(higher, ["gid", "block"]).select("gid", "idx", F.concat("path", "higher").alias("path"), F.col("last").alias("top"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx``, the place in the group ``gid`` by ``order``, and ``n``, the group's size.

    Rows are dealt by ranges, each numbers its own, and counts per range and group shift the
    numbers; so a group of any size is numbered without passing through one task.
    """
    ties = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["gid", *order, "tie"]
    ranged = stored(ties.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-ranges")
    placed = ranged.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("gid", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("start"))
    before = Window.partitionBy("gid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(
        counts.select(
            "gid", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("start")).alias("shift"), F.sum("c").over(Window.partitionBy("gid")).alias("n")
        ),
        "merkle-counts",
    )
    return placed.join(shifts, ["gid", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of all fields, 32 bytes: each is ``-``, or its length in UTF-8 bytes, ``:``, and the value."""

    def sized(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*[sized(f) for f in fields]), 256))


def merkle_manifest(
    docs: DataFrame,
    changes: dict[str, Column] | None = None,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
) -> DataFrame:
    """One row per row: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``; digests as hex.

    ``folded_root`` is what the root would be if the row's fields were as ``changes`` says (columns
    by the field's name; as they are without any), from the changed leaf and the kept states alone.
    """
    changes = changes or {}
    own = [F.col(f"`{f}`") for f in fields]
    changed = [changes.get(f, F.col(f"`{f}`")) for f in fields]
    group = F.col(f"`{group_col}`").cast("string")
    gid = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group))
    leaves = stored(docs.select(F.col(f"`{id_col}`").alias("id"), gid.alias("gid"), leaf_of(own).alias("leaf"), leaf_of(changed).alias("changed")), "merkle-leaves")
    climbed_leaves = stored(_climb_leaves(numbered(leaves, "id", "leaf")), "merkle-blocks")
    tops = climbed_leaves.where(f"idx % {BLOCK} = 0").select("gid", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    groups = stored(paths_above(tops), "merkle-groups")
    subroots = groups.where("idx = 0").select(F.lit("").alias("gid"), F.col("gid").alias("group"), F.col("top").alias("digest"))
    placed = stored(numbered(subroots, "group"), "merkle-subroots")
    to_root = paths_above(placed.select("gid", "idx", "n", "digest")).select("idx", F.col("path").alias("last"), F.col("top").alias("root"))
    of_group = placed.join(to_root, "idx").select(F.col("group").alias("gid"), "last", "root")
    above = stored(
        groups.join(of_group, "gid").select("gid", F.col("idx").alias("block"), F.concat("path", "last").alias("path"), F.col("top").alias("subroot"), "root"),
        "merkle-above",
    )
    return _folded(climbed_leaves.join(above, ["gid", "block"]), id_col)


def _folded(rows: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, FOLD_ROWS):
                batch = whole.slice(start, FOLD_ROWS)
                current, proof = words(batch["folded"]), words(batch["proof"])
                taken = batch["taken"].to_numpy().copy()
                paths = [np.frombuffer(p, dtype=LEVEL) for p in batch["path"].to_pylist()]
                lengths = np.array([len(p) for p in paths])
                for k in range(int(lengths.max(initial=0))):
                    at = np.flatnonzero(lengths > k)
                    level = np.array([paths[i][k] for i in at], dtype=LEVEL)
                    p, t = proof[at], taken[at]
                    current[at] = fold(level, current[at], p, t)
                    proof[at], taken[at] = p, t
                made = [raw(ended(proof, taken)), raw(current)]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["leaf"], batch["subroot"], batch["root"], *made], names=["id", "leaf", "subroot", "root", "proof", "folded"])

    kind = rows.schema["id"].dataType.simpleString()
    done = arrow_map(
        rows.select("id", "leaf", "subroot", "root", "folded", "proof", "taken", "path"), run, f"id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary"
    )
    hexed = lambda c: F.lower(F.hex(c))
    return done.select(
        F.col("id").alias(id_col), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        hexed("proof").alias("proof_sha256"), hexed("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
