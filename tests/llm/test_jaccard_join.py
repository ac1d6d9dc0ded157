import random

import numpy as np
import pytest

from lodestone.llm import components, jaccard_join
from lodestone.llm.components import connected_components
from lodestone.llm.jaccard_join import choose_boundary, jaccard_components, keep_one_of_each, prefix_length


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    return sorted((i, len(sets[k]), min(least[root(k)]) if sets[k] else i) for k, (i, _) in enumerate(rows))


def corpus(seed, groups, size, words=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(1, 5))) for _ in range(400)]
    out = []
    passage = r.choices(vocabulary, k=40)
    for g in range(groups):
        base = r.choices(vocabulary, k=r.choice([4, 6, 9, 14, words, 2 * words]))
        if g % 3 == 0:
            base = passage + base
        for _ in range(r.randint(1, size)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 25))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy).replace(" a", "\n A"))
    r.shuffle(out)
    return [(k * 7 % (10 * len(out)), t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 24)
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", 2400)
    monkeypatch.setattr(jaccard_join, "MEMBER_BLOCK", 24)
    rows = corpus(seed, 40, 12) + [(100_000 + i, t) for i, t in corpus(seed + 10, 1, 1, 80) * 1]
    base = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna".split()
    r = random.Random(seed)
    for k in range(90):  # one large group of near copies, at all distances
        copy = base * 3
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = f"w{r.randrange(50)}"
        rows.append((200_000 + k, " ".join(copy)))
    rows += [(300_000, None), (300_001, ""), (300_002, " \n"), (300_003, "one two"), (300_004, "One\ttwo"), (300_003, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(x) for x in jaccard_components(docs).collect())
    assert found == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).collect() == []
    rows = [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (None, "a b c d e f", 7), (None, None, 8), (2, "a b c d e f", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    assert sorted(x.component_id for x in jaccard_components(docs).where("n_shingles > 0").collect()) == [1, 1, 1, 1]
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or -1, x.component_id) for x in kept.collect()) == [(-1, 8), (1, 5)]


def test_rows_of_one_id_are_decided_each_by_itself(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    one, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, one, 0), (1, other, 1), (2, one + " end", 2), (None, one + " last", 3), (None, other + " last", 4), (5, None, 5), (5, None, 6), (6, "x " * 300_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` int")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(x["row"] for x in kept.collect()) == [0, 1, 5, 6, 7]


def test_a_large_group_with_members_apart_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", 600)
    monkeypatch.setattr(jaccard_join, "MEMBER_BLOCK", 16)
    r = random.Random(5)
    shared = [f"s{k}" for k in range(12)]
    rows = []
    for k in range(60):  # one tight group, chains beside it, and texts that only share a passage
        own = [f"c{j}" for j in range(30)]
        own[k % 30] = f"v{k}"
        rows.append((k, " ".join(shared + own)))
    chain = [f"z{j}" for j in range(60)]
    for k in range(25):
        chain = chain[2:] + [f"n{k}a", f"n{k}b"]
        rows.append((1000 + k, " ".join(shared + chain)))
    for k in range(60):
        rows.append((2000 + k, " ".join(shared + [f"q{r.randrange(10**6)}" for _ in range(r.randint(8, 60))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in jaccard_components(docs).collect()) == brute(rows)


def test_prefixes_and_boundary():
    assert [prefix_length(s) for s in (1, 3, 4, 8, 100)] == [1, 1, 2, 3, 26]
    assert choose_boundary({600: 10}, 5.0) == 2
    assert choose_boundary({4: 1000}, 100.0) >= 4


def test_texts_of_all_documents_are_shuffled_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", 600)
    monkeypatch.setattr(jaccard_join, "MEMBER_BLOCK", 16)
    own = [f"c{j}" for j in range(40)]
    rows = [(k, " ".join([*own[: k % 40], f"v{k}", *own[k % 40 + 1 :]])) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    read, exact = [], jaccard_join._exact_edges
    monkeypatch.setattr(jaccard_join, "_exact_edges", lambda parts: read.append(parts.inputFiles()) or exact(parts))
    found = jaccard_components(spark.read.parquet(f"{tmp_path}/documents"))
    assert sorted(tuple(x) for x in found.collect()) == brute(rows)
    assert len(read) == 2  # the blocks of the large group are compared in two steps
    assert not [f for files in read for f in files if str(tmp_path) in f]


def test_a_step_of_the_components_has_few_shuffles(spark, monkeypatch):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(50, 90)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    edges += [(500, 501), (501, 500), (7, 7), (None, 3)]
    label = {k: k for e in edges for k in e if k is not None and e[0] is not None and e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    plans, kept = [], components.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(components, "stored", watched)
    given = spark.createDataFrame(edges, "a long, b long")
    assert dict(tuple(x) for x in connected_components(given).collect()) == label
    assert len(plans) > 1
    for plan in plans[1:]:
        # Dealt by the node twice, for a minimum and for its edges, then made distinct (Spark reads equal branches once).
        assert plan.count("Exchange") <= 7


def test_spanning_edges_start_at_the_first_member():
    links = np.zeros((6, 6), dtype=bool)
    for i, j in ((1, 2), (2, 4), (4, 5)):
        links[i, j] = links[j, i] = True
    assert sorted(jaccard_join.spanning(links)) == [(1, 2), (1, 4), (1, 5)]
