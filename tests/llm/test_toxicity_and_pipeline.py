import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import toxicity as tox

CLEAN = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "con", "tur") for b in ("em", "um", "or", "a", "et", "is", "o")]
TOXIC = ["scumbag", "moronic", "vileword", "filthpot"]


def corpus(n, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = r.choices(CLEAN, k=r.randint(5, 120))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                words[r.randrange(len(words))] = r.choice(TOXIC)
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    rows, labels = corpus(900)
    base = [rows[k][1] for k in (1, 2, 3)]
    for k, text in enumerate(base):
        rows += [(1000 + 10 * k + j, text.replace(" ", "  ", j), "en", "s0", 0) for j in range(4)]
        rows.append((2000 + k, text + " lorem extra", "de", "s1", 0))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, dict((i, t) for i, _, t in labels)


def test_held_out_accuracy(spark, tables):
    folder, rows, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    network = tox.fitted_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r.doc_id: r["__score"] for r in tox.score_toxicity(docs, network).collect()}
    assert scored[3000] == scored[3001] == 0.0 and len(scored) == len(rows)
    held = [i for i in labels if is_held_out(i)]
    right = [(scored[i] >= tox.THRESHOLD) == labels[i] for i in held]
    assert np.mean(right) > 0.95
    kept = tox.drop_toxic(docs, network)
    assert kept.columns == docs.columns and kept.count() == sum(s < tox.THRESHOLD for s in scored.values())


def slow_score(net, text):
    """The network as plain loops, window by window, word by word."""
    words = tox.words_of(text)
    if not words:
        return 0.0
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    best = -np.inf
    starts = [0]
    while starts[-1] + tox.WINDOW < len(words):
        starts.append(starts[-1] + tox.STRIDE)
    for at in starts:
        vectors = []
        for w in words[at : at + tox.WINDOW]:
            raw = w.encode()
            grams, _ = tox.grams_of([raw])
            vectors.append(np.concatenate([p["words"][zlib.crc32(raw) % tox.WORD_ROWS], p["grams"][grams].max(axis=0)]))
        states = {}
        for d, order in (("f", range(len(vectors))), ("b", range(len(vectors) - 1, -1, -1))):
            h, n = np.zeros(tox.HIDDEN), tox.HIDDEN
            for k in order:
                x, hu = vectors[k] @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
                r, z = sig(x[:n] + hu[:n]), sig(x[n : 2 * n] + hu[n : 2 * n])
                c = np.tanh(x[2 * n :] + r * hu[2 * n :])
                h = (1 - z) * c + z * h
                states[d, k] = h
        both = np.array([np.concatenate([states["f", k], states["b", k]]) for k in range(len(vectors))])
        e = np.tanh(both @ p["Wa"]) @ p["va"]
        alpha = np.exp(e - e.max())
        best = max(best, float((alpha / alpha.sum()) @ both @ p["wo"] + p["bo"][0]))
    a, b = net.scale
    return 1 / (1 + np.exp(-(a * best + b)))


def test_scores_equal_plain_loops_over_all_windows():
    rows, labels = corpus(300, seed=4)
    net = tox.fit([t for _, t, *_ in rows], np.array([y for _, _, y in labels]))
    r = random.Random(2)
    texts = [rows[k][1] for k in range(6)] + [None, "", "?!", "scumbag", " ".join(r.choices(CLEAN + TOXIC, k=333)), "lorem " * 100]
    assert tox.Scorer(net).scores(texts) == pytest.approx([slow_score(net, t) for t in texts], abs=1e-4)


def test_toxicity_edges(spark):
    rows, labels = corpus(200)
    kinds = "doc_id long, text string, score double, __score int, `row` int"
    docs = spark.createDataFrame([(i, t, 1.0, 2, 3) for i, t, *_ in rows], kinds)
    label_table = spark.createDataFrame([*labels, *labels[:20], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    network = tox.fitted_on(docs, label_table)
    long = "lorem " * 200_000 + "scumbag moronic vileword filthpot"
    more = docs.unionByName(spark.createDataFrame([(7, long, 1.0, 2, 3), (7, long, 1.0, 2, 3), (None, rows[0][1], 1.0, 2, 3)], kinds))
    kept = tox.drop_toxic(more, network)
    assert kept.columns == more.columns and {x["__score"] for x in kept.collect()} == {2}
    scored = tox.score_toxicity(more, network, score_col="score")
    assert sorted(scored.columns) == sorted(more.columns) and scored.count() == 203
    assert len({x.score for x in scored.where("doc_id = 7 and length(text) > 1000000").collect()}) == 1
    empty = docs.limit(0)
    unfitted = tox.fitted_on(empty, label_table.limit(0))
    assert tox.drop_toxic(empty, unfitted).collect() == [] and tox.drop_toxic(docs, unfitted).count() == 200


def test_stages_on_an_empty_table(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_windows_cover_everything_and_missing_labels():
    for n in (1, 31, 32, 33, 48, 49, 500):
        w = tox.windows_of(np.arange(1, n + 1))
        assert set(range(1, n + 1)) <= set(w.ravel().tolist()) and w.shape[1] == tox.WINDOW
    assert tox.Scorer(tox.fit(["a b"] * 30, np.zeros(30))).scores(["a b", None]).tolist() == [0.0, 0.0]


def test_gradients_are_right():
    net = tox.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.Generator(np.random.PCG64(1))
    x = r.normal(size=(6, tox.WORD_DIM + tox.CHAR_DIM))
    index = r.integers(0, 7, (3, 5))
    index[:, 0] = 1
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = tox.sigmoid(net.forward(net.projections(x), index)[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    logits, tape = net.forward(net.projections(x), index, keep=True)
    grads, dproj = net.backward(tape, index, (tox.sigmoid(logits) - y), len(x))
    grads["Wf"] = x.T @ dproj["f"]
    for name in ("wo", "va", "Wa", "Uf", "Ub", "Wf"):
        flat = net.p[name].reshape(-1)
        for k in (0, flat.size // 2, flat.size - 1):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_pipeline_stage_by_stage(spark, tables):
    folder, rows, labels = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = {r[0]: r[1] or "" for r in rows}
    before = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        after = [r.doc_id for r in docs.collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        if name == "toxicity":
            gone = before - set(after)
            assert all(labels.get(i, 0) for i in gone) and len(gone) > 0.8 * sum(labels.values())
        if name == "exact_dedup":
            groups = {}
            for i in before:
                groups.setdefault("".join(texts[i].split()), []).append(i)
            assert set(after) == {min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values()}
        if name == "jaccard_join":
            def shingles(t):
                w = t.lower().split()
                return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
            sets = {i: shingles(texts[i]) for i in before}
            linked = {i: [j for j in before if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in before}
            expected = set()
            for i in before:
                seen, queue = {i}, [i]
                while queue:
                    queue += [j for j in linked[queue.pop()] if j not in seen and not seen.add(j)]
                expected.add(min(seen))
            assert set(after) == expected
        before = set(after)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in out} == before
    assert all(r.round_trip and r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in out)
