"""The subword counter against a plain greedy loop, and a cap that is measured by it."""

import numpy as np

from lodestone.functions.subwords import PIECE_BYTES, Subwords, counting, from_ranks
from lodestone.operators.chunking import chunk_articles, within_cap

def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(text, pieces):
    data, at, n = (text or "").encode(), 0, 0
    while at < len(data):
        size = next((k for k in range(min(PIECE_BYTES, len(data) - at), 0, -1) if data[at : at + k] in pieces), 1)
        at, n = at + size, n + 1
    return n


def test_counts_like_a_plain_loop():
    r = np.random.Generator(np.random.PCG64(4))
    letters = "abcdé "
    pieces = {"".join(r.choice(list(letters), size=int(r.integers(1, 6)))).encode() for _ in range(80)} | {b"\xc3"}
    texts = ["", None, "a", "zzz", "abc", "éé a"] + ["".join(r.choice(list(letters + "z"), size=int(r.integers(0, 200)))) for _ in range(200)]
    counter = Subwords(pieces)
    assert counter.counts(texts).tolist() == [greedy(t, pieces) for t in texts]
    assert [counter(t or "") for t in texts] == counter.counts(texts).tolist()
    assert Subwords([]).counts(["ab", ""]).tolist() == [2, 0] and counter.counts([]).tolist() == []


def test_a_cap_in_subwords(spark):
    counter = from_ranks(vocabulary())
    assert counter("hello world") == 2 and counter("x" * 100_000) < 100_000
    text = "# SOURCE_URL: u\n# T\nintro\n## A\n" + "\n".join(f"Đây là câu số {k}, có vài từ nữa." for k in range(60))
    docs = spark.createDataFrame([("d", "a", text), ("d", "b", f"# SOURCE_URL: {'u' * 600}-{'đ' * 400}\n# T\nx")], "article_type string, article_slug string, text string")
    chunks = chunk_articles(docs, 120, fail=False, **counting(spark, counter))
    rows = chunks.where("article_slug = 'a'").orderBy("chunk_idx").collect()
    assert [r["token_count"] for r in rows] == [counter(r["text"]) for r in rows] and max(r["token_count"] for r in rows) <= 120
    assert len(rows) > 3 and rows[1]["split_part"].startswith("1/")
    kept, failed = within_cap(chunks, 120)
    assert {r["article_slug"] for r in kept.collect()} == {"a"} and [r["article_slug"] for r in failed.collect()] == ["b"]
