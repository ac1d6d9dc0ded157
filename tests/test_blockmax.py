"""Block-max search against the search that scores every posting."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import blockmax, bm25
from lodestone.sources.tables import materialised


def corpus(spark, n):
    r = np.random.Generator(np.random.PCG64(9))
    p = 1 / np.arange(1, 400)
    words = lambda k: " ".join(f"w{x}" for x in r.choice(399, size=k, p=p / p.sum()))
    rows = [(f"c{k:05d}", words(int(r.integers(3, 60)))) for k in range(n)]
    rows += [(f"d{k:05d}", rows[k][1]) for k in range(50)] + [("e", ""), ("f", None)]  # ties, and chunks without terms
    asked = [(k, words(int(r.integers(1, 9)))) for k in range(60)] + [(60, "nowhere"), (61, ""), (62, "w1 w1 w2"), (63, " ".join(f"w{x}" for x in range(399)))]
    return spark.createDataFrame(rows, "id string, text string"), spark.createDataFrame(asked, "question_id long, question string")


def plain(found):
    return sorted(tuple(r) for r in found.select("question_id", "rank", "chunk_id", "score").collect())


def test_same_rows_and_fewer_postings(spark, tmp_path, monkeypatch):
    chunks, asked = corpus(spark, 3000)
    postings = materialised(bm25.term_frequencies(chunks), "postings")
    stats = bm25.corpus_stats(chunks)
    want = plain(bm25.sparse_topk(asked, postings, stats))
    index = blockmax.build_blocks(postings, stats, f"file://{tmp_path}/one")
    assert index.chunks.select("shard").distinct().count() == 1
    assert plain(blockmax.blockmax_topk(asked, index)) == want
    short = asked.where("question_id < 60")
    scored, possible = blockmax.postings_scored(short, index).first()
    assert 0 < scored < 0.7 * possible
    monkeypatch.setattr(blockmax, "SHARD_CHUNKS", 300)
    monkeypatch.setattr(blockmax, "MAX_ASKED", 100)
    several = blockmax.build_blocks(postings, stats, f"file://{tmp_path}/several", bm25.inverse_frequencies(postings, stats).select("term_index", "n"))
    assert several.chunks.select("shard").distinct().count() == 11
    assert plain(blockmax.blockmax_topk(asked, several)) == want
    assert plain(blockmax.blockmax_topk(asked, blockmax.open_blocks(spark, f"file://{tmp_path}/several"), k=1)) == [r for r in want if r[1] == 1]
    assert blockmax.blockmax_topk(asked.where(F.lit(False)), index).collect() == []
    assert plain(blockmax.blockmax_topk(asked, index, k=4000)) == plain(bm25.sparse_topk(asked, postings, stats, k=4000))
