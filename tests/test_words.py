"""Words found on a batch's bytes are those of ``terms``, and their indices those of ``term_index``."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.words import SHORT, plain_words, word_indices
from lodestone.operators import bm25
from lodestone.operators.chunking import parsed_articles
from lodestone.operators.embed import embedded

RANGES = [(0, 0x300), (0x400, 0x483), (0x1E00, 0x1F00), (0x2010, 0x2028), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]


def test_every_plain_character_gives_the_words_of_terms(spark):
    every = [chr(c) for low, high in RANGES for c in range(low, high)]
    random.seed(7)
    texts = [f"a{c}B{c}{c} {c}" for c in every] + ["".join(random.choices(every[:0x380] + list(" aB_1"), k=random.randrange(40))) for _ in range(3000)]
    texts += ["", "x" * (SHORT + 9) + " " + "é" * SHORT, None, "Σας α", "é x", "İ i"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4, "k")
    found = bm25.with_entries(rows, hashed=False).select("k", "dl", F.transform("entries", lambda e: e["term_index"]).alias("got"), T.is_plain(F.col("text")).alias("plain"))
    both = found.join(rows.select("k", T.terms(F.col("text")).alias("want")), "k")
    wrong = both.where((F.array_sort(F.array_distinct("want")) != F.array_sort("got")) | (F.size("want") != F.col("dl")))
    assert wrong.collect() == []
    plain = {r["k"] for r in found.where("plain").collect()}
    assert len(plain) > 20_000 and not plain & set(range(len(texts) - 4, len(texts)))
    hashed = bm25.with_entries(rows).select("k", F.transform("entries", lambda e: e["term_index"]).alias("got"))
    words = rows.select("k", F.array_sort(F.array_distinct(F.transform(T.terms(F.col("text")), T.term_index))).alias("want"))
    assert hashed.join(words, "k").where("got != want").count() == 0


def test_words_of_a_slice_stay_in_their_rows():
    texts = pa.array(["lost", "", "A b", None, "b1", "-", "Ñandú x"])[1:]
    row, words = plain_words(texts)
    assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == [(1, "a"), (1, "b"), (3, "b1"), (5, "ñandú"), (5, "x")]
    long = pa.array(["é" * 200, "a", "", "b" * SHORT, "c" * (SHORT + 1)])
    assert word_indices(long[1:]).tolist() == [zlib.crc32(w.encode()) for w in long.to_pylist()[1:]]
    assert word_indices(long).tolist() == [zlib.crc32(w.encode()) for w in long.to_pylist()]


def test_only_texts_go_to_the_embedder_and_plans_name_terms_once(spark):
    rows = spark.createDataFrame([(1, "a b", "other")], "k int, text string, more string")
    sent = embedded(rows, lambda: lambda texts, task: [[1.0, 2.0] for _ in texts], 2, input_col="text")
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    assert sent.collect()[0].dense == [1.0, 2.0]
    counted = bm25.with_entries(rows)._jdf.queryExecution().executedPlan().toString()
    assert counted.count("regexp_extract_all") <= 2


@pytest.mark.parametrize("lead", ["Nội dung bài viết", "Nội dung bài viếtx", "Nội dung bài viết\tx", "", "Nội dung bài viết x"])
def test_parsing_in_steps_is_parse_article(spark, lead):
    text = f"# SOURCE_URL: u \r\n\r\n#  T \r\n\r\n{lead}\r\n  z 　\n"
    rows = spark.createDataFrame([("d", "s", text), ("d", "n", None)], "article_type string, article_slug string, text string")
    names = ["url", "title", "body"]
    steps = sorted(tuple(r) for r in parsed_articles(rows).select("article_slug", *names).collect())
    whole = sorted(tuple(r) for r in rows.select("article_slug", *[c.alias(n) for n, c in T.parse_article(F.col("text")).items()]).collect())
    body = "z" if lead in ("", "Nội dung bài viết") else "x\n  z" if lead.endswith("\tx") else f"{lead}\n  z"
    assert steps == whole == [("n", "", "", ""), ("s", "u", "T", body)]
