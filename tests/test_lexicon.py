"""The segmenter against plain loops, and length sketches against exact ranks."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate, lexicon
from lodestone.operators import index as ix
from lodestone.operators.build import build_index

TEXTS = ["Đau đầu là gì, đau đầu và sốt cao", "sốt cao, đau  đầu", "đau\nđầu sốt cao một_hai x² 3", None, "", "thuốc giảm đau đầu giảm đau"] * 4


def runs_of(text):
    return [r.split(" ") for r in re.findall(r"[^\W_]+(?: [^\W_]+)*", (text or "").lower())]


def test_collocations_like_plain_loops(spark):
    runs = [r for t in TEXTS for r in runs_of(t)]
    single, pairs = Counter(w for r in runs for w in r), Counter(p for r in runs for p in zip(r, r[1:]))
    total, want = sum(single.values()), {}
    for (a, b), n in pairs.items():
        weight = math.log(n * total / (single[a] * single[b])) / -math.log(n / total)
        if n >= 5 and weight >= 0.5:
            want[a, b] = (n, pytest.approx(weight, abs=1e-8))
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    found = {(r["first"], r["second"]): (r["n"], r["weight"]) for r in lexicon.collocations(docs).collect()}
    assert found == want and ("sốt", "cao") in found
    assert lexicon.collocations(docs.limit(0)).collect() == []
    top = lexicon.cut_lexicon(lexicon.collocations(docs), 2).collect()
    assert len(top) == 2 and min(r["weight"] for r in top) >= sorted(w for _, w in found.values())[-2]


def test_best_paths_are_best():
    r = random.Random(1)
    for _ in range(500):
        w = [r.choice([0, 0, 0.5, 0.7, 0.9, 1.0]) for _ in range(r.randint(0, 8))]
        ways = (c for n in range(len(w) + 1) for c in itertools.combinations(range(len(w)), n) if all(b - a > 1 for a, b in zip(c, c[1:])))
        got = lexicon.best_path(w)
        assert all(b - a > 1 for a, b in zip(got, got[1:])) and all(w[i] for i in got)
        assert sum(w[i] for i in got) == pytest.approx(max(sum(w[i] for i in c) for c in ways))


def test_segmenting_changes_single_spaces_only():
    known = {("giảm", "đau"): 0.9, ("đau", "đầu"): 0.8, ("thuốc", "giảm"): 0.6}
    assert lexicon.segmented("Thuốc giảm đau đầu", known) == "Thuốc_giảm đau_đầu"
    assert lexicon.segmented("giảm đau, đau  đầu\nđau đầu.", known) == "giảm_đau, đau  đầu\nđau_đầu."
    assert lexicon.segmented("", known) == "" and lexicon.segmented("một", known) == "một"


def test_segmented_text_reaches_both_encoders(spark, tmp_path):
    words = spark.createDataFrame([("đau", "đầu", 5, 0.9)], "first string, second string, n long, weight double")

    def connect():
        return lambda texts, task: [[float("đau_đầu" in t), 1.0] for t in texts]

    articles = spark.createDataFrame([("d", "a", "# SOURCE_URL: u\n# T\nđau đầu")], "article_type string, article_slug string, text string")
    build_index(articles, f"file://{tmp_path}", connect, 2, segment=lexicon.segmenter(words))
    row = ix.read_index(spark, f"file://{tmp_path}").first()
    assert row["dense"] == [1.0, 1.0] and "đau đầu" in row["text"]
    import zlib

    assert zlib.crc32("đau_đầu".encode()) in {x["term_index"] for x in row["sparse"]}


def test_sketches_merge_and_refresh(spark):
    sections = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"), (F.col("id") % 700).cast("string").alias("article_slug"),
        F.repeat(F.lit("x"), (F.col("id") * 7919 % 997).cast("int")).alias("content"),
    )
    touched = sections.where("article_slug in ('5', '6')").select("type", "article_slug").distinct()
    now = sections.where("article_slug <> '5'")
    sketches = evaluate.refreshed_sketches(evaluate.profile_sketches(sections), touched, now)
    for row in evaluate.sketched_profile(sketches).collect():
        sizes = sorted(r[0] for r in now.where(F.col("type") == row["type"]).select(F.length("content")).collect())
        assert row["files"] == now.where(F.col("type") == row["type"]).select("article_slug").distinct().count()
        assert row["sections_per_file"] == pytest.approx(len(sizes) / row["files"])
        for q, value in ((0.5, row["median_chars"]), (0.9, row["p90_chars"])):
            assert abs(sum(s <= value for s in sizes) / len(sizes) - q) < 0.02
