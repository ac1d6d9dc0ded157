import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import lm

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plainly(rows):
    """Per row: held out, tokens, known, all training tokens, base score; by plain loops."""
    kept = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10]
    counts = Counter(w for r in kept for w in words(r[1]))
    if kept:
        counts[None] = len(kept)
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    return sorted(out)


def scored(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.language_model_scores(docs).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got) or not rows
    return sorted((str(r[0]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)


def test_words_of_slices():
    texts = ["A b\x1cC", " x y É z\x85w ", "", "\t\n\x0b\x0c\r ", None, "İIı", "a" * 1000 + " b", "q  w\x00e"] * 5
    whole = pa.array(texts, pa.string())
    for at, n in ((0, 40), (7, 20), (31, 9)):
        flat, parent = lm.words_of(whole.slice(at, n))
        want = [(k, w) for k, t in enumerate(texts[at : at + n]) for w in words(t)]
        assert list(zip(parent.tolist(), flat.to_pylist(), strict=True)) == want


def test_gradients_like_differences():
    r = np.random.Generator(np.random.PCG64(0))
    noise = r.random(lm.CLASSES)
    net = lm.LogBilinear(noise / noise.sum())
    for name, x in net.p.items():
        net.p[name] = (x + r.normal(0, 0.3, x.shape)).astype(np.float64)
    token, before = r.integers(0, lm.CLASSES, 40), r.integers(0, lm.CLASSES + 1, (40, lm.CONTEXT))
    drawn = r.integers(0, lm.CLASSES, 8)
    grads = net.gradients(token, before, drawn)
    for name, where in (("before", (before[3, 1], 2)), ("place", (1, 3, 4)), ("target", (token[0], 5)), ("target", (drawn[0], 1)), ("bias", (token[2],)), ("bias", (drawn[1],))):
        x, h = net.p[name], 1e-5
        old = x[where]
        x[where] = old + h
        up = net.objective(token, before, drawn)
        x[where] = old - h
        down = net.objective(token, before, drawn)
        x[where] = old
        assert grads[name][where] == pytest.approx((up - down) / (2 * h), rel=2e-3, abs=1e-4)


@pytest.mark.parametrize("scale", [1.0, 60.0])
def test_probabilities_sum_to_one(scale):
    net = lm.LogBilinear(np.full(lm.CLASSES, 1 / lm.CLASSES))
    net.p["target"] *= scale
    net.p["before"] *= scale
    before = np.array([[3, lm.BEGIN, lm.BEGIN]])
    found = net.log_probs(np.arange(lm.CLASSES), np.repeat(before, lm.CLASSES, axis=0))
    assert np.exp(found).sum() == pytest.approx(1, abs=1e-4)


def test_examples_do_not_cross_texts():
    column = pa.array([np.array(x, dtype=np.uint16).tobytes() for x in ([5, 6, 0], [0], [7, 0])], pa.binary())
    token, before, bounds = lm.examples(column)
    b = lm.BEGIN
    assert token.tolist() == [5, 6, 0, 0, 7, 0] and bounds.tolist() == [0, 3, 4, 6]
    assert before[:, :2].tolist() == [[b, b], [5, b], [6, 5], [b, b], [b, b], [7, b]]


def test_counts_like_plain_loops(spark, monkeypatch):
    rows = [(i, f"The cat {i % 7} sat\nON the {'mat ' * (i % 4)}") for i in range(300)]
    rows += [(None, None), (None, "no Id"), (3, ""), (3, "twice"), (3, "twice"), (4000, "x" * 5000 + " x"), (4001, "word " * 50_000), (4002, "\x00 é É")]
    assert scored(spark, rows) == plainly(rows)
    monkeypatch.setattr(lm, "FREQUENT", 5)  # most words are looked up in the join
    assert scored(spark, rows) == plainly(rows)


def test_no_training_rows_and_no_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    rows = [(i, "some words here") for i in held]
    assert scored(spark, rows) == plainly(rows)
    assert scored(spark, []) == []


def test_model_predicts_held_out_texts_better_than_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.language_model_scores(docs).where("held_out").toPandas()
    assert (got.score > got.base_score).mean() > 0.95
    assert (got.score.sum() - got.base_score.sum()) / got.n_tokens.sum() > 0.15
