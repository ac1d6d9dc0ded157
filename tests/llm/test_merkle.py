import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """All levels of a tree, plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def path(levels, at):
    """Each level's run and the place in it."""
    for level in levels[:-1]:
        yield level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
        at //= 3


def plainly(rows, change):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, places = {}, {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in own])
        places[s] = own
    top = climb([trees[s][-1][0] for s in sources])
    root, found = top[-1][0], []
    for k, s in enumerate(sources):
        for at, r in enumerate(places[s]):
            proof, f = "", leaf(change(r))
            for run, slot in [*path(trees[s], at), *path(top, k)]:
                proof += "".join(run[:slot] + run[slot + 1 :])
                f = sha("".join([*run[:slot], f, *run[slot + 1 :]]))
            found.append((str(r[0]), leaf(r), trees[s][-1][0], root, sha(proof), f, f == root))
    return sorted(found)


def tampered(row):
    if row[0] is None or row[4] is None or zlib.crc32(str(row[0]).encode()) % 2:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.merkle_manifest(docs, {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    return sorted(tuple(str(v) if i == 0 else v for i, v in enumerate(r)) for r in got.collect())


def test_hash_of_many_blocks_like_the_standard_library():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    words = np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, 8).astype(np.uint32)
    state, text = np.tile(merkle.START, (20, 1)), [""] * 20
    for taken in range(1, 5):
        state = merkle.compress(state, merkle.as_block(words))
        text = [t + d.hex() for t, d in zip(text, digests, strict=True)]
        got = merkle.ended(state, np.full(20, taken))
        assert [g.astype(">u4").tobytes().hex() for g in got] == [sha(t) for t in text]
    assert merkle.ended(merkle.START[None, :], np.zeros(1))[0].astype(">u4").tobytes().hex() == sha("")


def test_trees_of_all_small_sizes(spark):
    rows = [(100 * n + i, f"s{n:02d}", "en", i, f"text {i}\nof {n}") for n in range(1, 32) for i in range(n)]
    assert run(spark, rows) == plainly(rows, tampered)


def test_several_passes_in_one_large_group(spark):
    n = 2 * merkle.BLOCK + 1500
    rows = [(i, "hot" if i % 9 else f"s{i % 5}", None, i, "a\nb" if i % 3 else None) for i in range(n)]
    assert sum(r[1] == "hot" for r in rows) > merkle.BLOCK
    assert run(spark, rows) == plainly(rows, tampered)


def test_many_groups_of_one(spark):
    rows = [(i, f"group {i}", "de", None, "x\n") for i in range(merkle.BLOCK + 40)]
    assert run(spark, rows) == plainly(rows, tampered)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, None, None, None, None), (None, "é", "x", 1, "\n"), (None, "é", "x", 2, ""), (5, None, "-", 0, "0:"), (5, "", "", 3, "a\n"),
        (5, "", "", 3, "a\n"), (5, "", "", 3, "b"), (6, "z", "l", 9, "word\n" * 100_000), (7, "z", "l", 9, "😀\n😀"), (-1, "=", "l", 9, "\n\n"),
    ]
    assert run(spark, rows) == plainly(rows, tampered)


def test_one_row_no_rows_and_other_columns(spark):
    one = [(1, "s", "en", 1, "t")]
    got = run(spark, one)
    assert got == plainly(one, tampered) and got[0][4] == sha("") and got[0][3] == got[0][1]
    assert run(spark, []) == []
    docs = spark.createDataFrame([("a", "g", "x", 1), ("b", "g", "y", 2), ("c", "h", "y", 2)], "key string, grp string, gid string, idx int")
    made = merkle.merkle_manifest(docs, fields=("key", "gid"), id_col="key", group_col="grp")
    assert made.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert made.where("verified").count() == 3
