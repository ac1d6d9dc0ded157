import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.bpe import Decoder, bpe_decode, bpe_encode, bpe_round_trip
from lodestone.llm.exact_dedup import drop_copies, exact_groups

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(5, "a b", 1), (3, "a  b", 2), (9, "ab", 3), (1, None, 4), (2, " \n\x0b", 5), (7, "b a", 6), (7, "b a", 7), (None, "ab", 8), (4, " ab", 9)]


def white(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    out = []
    for i, t, _ in rows:
        group = [(-len(u or ""), j is not None, j or 0, j) for j, u, _ in rows if white(u) == white(t)]
        keep = min(group, key=lambda g: g[:3])[3]
        out.append((i, keep, len(group), hashlib.sha256(white(t).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id long")


def test_groups_equal_brute_force_even_with_a_weak_hash(spark):
    for hasher in (None, lambda text: F.substring(F.md5(text), 1, 1)):
        groups = exact_groups(frame(spark), **({"hasher": hasher} if hasher else {})).collect()
        assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in groups), key=str) == brute(ROWS)
        assert sum(g.kept for g in groups) == len({white(t) for _, t, _ in ROWS})


def test_one_row_of_each_group_stays_with_its_columns(spark):
    kept = drop_copies(frame(spark))
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert sorted((r.doc_id, r.keep_id) for r in kept.collect()) == [(2, 5), (3, 2), (4, 9), (7, 6)] or len(kept.collect()) == 4
    assert exact_groups(frame(spark, [])).collect() == [] == drop_copies(frame(spark, [])).collect()


TEXTS = ["", None, "Hello world", "a<|endoftext|>b  c\n\n d", "aaaaaaaaaaa", "x \x1c\x1d y\x85z  ", "'s't I'll  IT'S", " \t", "é́中文 １２ ½²", "😀😀 \U0001F468‍", "z" * 3000]


def test_ids_and_texts_equal_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    rows = [(k, t, [1]) for k, t in enumerate(TEXTS)] + [(None, "Hello world", None), (2, "Hello world", [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    encoded = bpe_encode(docs, VOCABULARY)
    for r in bpe_decode(encoded, VOCABULARY).collect():
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "Hello world") or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == text
    assert encoded.count() == len(rows)
    assert bpe_encode(docs.limit(0), VOCABULARY).collect() == []


def test_invalid_bytes_become_replacement_characters():
    decoder, library = Decoder(open(VOCABULARY, "rb").read()), Tokenizer.from_file(VOCABULARY)
    lists = [[447, 247], [447], [], [220, 50256, 13]]
    flat, bounds = np.array([i for x in lists for i in x]), np.cumsum([0, *map(len, lists)])
    assert decoder.decode(flat, bounds) == [library.decode(ids, skip_special_tokens=False) for ids in lists]


def test_round_trip_in_one_pass(spark):
    library = Tokenizer.from_file(VOCABULARY)
    long = "Ein sehr langer Text, né? " * 200_000
    rows = [(k, t, "x", 0) for k, t in enumerate([*TEXTS, long])] + [(3, TEXTS[3], "x", 0), (None, "a", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int")
    for kept in (("decoded", "ids"), ()):
        out = bpe_round_trip(docs, VOCABULARY, keep=kept)
        assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip", "decoded"]
        found = out.collect()
        assert len(found) == len(rows)
        for r in found:
            text = (dict((i, t) for i, t, _, _ in rows)[r.doc_id]) or ""
            assert r.ids == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
            assert r.round_trip and r.decoded == text
    assert bpe_round_trip(docs, VOCABULARY, keep=("decoded",), decoded=False).columns == ["doc_id", "decoded", "ids", "n_tokens", "round_trip"]
    assert bpe_round_trip(docs.limit(0), VOCABULARY).collect() == []
    back = bpe_decode(bpe_encode(docs, VOCABULARY, keep=("decoded",)), VOCABULARY)
    assert back.columns == ["doc_id", "ids", "decoded"] and back.where("doc_id is null").first().decoded == "a"


def test_clashing_names_and_long_texts_in_exact_dedup(spark):
    rows = [(1, "a b", 1, 2, 3), (2, "ab", 4, 5, 6), (3, "x" * 2_000_000, 7, 8, 9), (4, "x " * 2_000_000, 0, 0, 0), (4, "x " * 2_000_000, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, `row` int, __sha int, keep_id int")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["row"]) for r in kept.collect() if r.doc_id < 4) == [(1, 1)]
    assert [r.doc_id for r in kept.collect()].count(4) == 1
