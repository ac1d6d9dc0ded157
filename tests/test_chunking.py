import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.sections import article_parts, guarded, recursive_split, split_sections, whitespace_tokens
from lodestone.operators import chunking
from lodestone.operators.chunking import article_chunks, chunk_articles, parsed_articles, within_cap

ARTICLE = (
    "# SOURCE_URL: https://example.org/tools/hand-saw/\r\n\r\n# Keeping a hand saw\r\n\r\nNội dung bài viết\r\n\r\nA saw lasts.\r\n\r\n"
    "### Storage\r\n\r\nHang it dry.\r\n\r\n## Teeth\r\n\r\n#### Rust\r\n\r\nOil the blade.\r\n\r\n## Blade\r\n\r\n### Empty\r\n\r\n"
    "## Handle\r\n\r\nBeech wood.\r\n\r\n##### Screws\r\n\r\nTighten them.\r\n"
)
PATHS = ["", "Storage", "Teeth > Rust", "Handle", "Handle > Screws"]


def article(spark, *texts):
    return spark.createDataFrame([("drug", f"s{k}", t) for k, t in enumerate(texts)], "article_type string, article_slug string, text string")


def test_parse_article(spark):
    rows = parsed_articles(article(spark, ARTICLE, "", "no marks at all")).orderBy("article_slug").collect()
    assert (rows[0].url, rows[0].title) == ("https://example.org/tools/hand-saw/", "Keeping a hand saw")
    assert rows[0].body.startswith("A saw lasts.")
    assert (rows[1].url, rows[1].title, rows[1].body) == ("", "", "")
    assert (rows[2].url, rows[2].title, rows[2].body) == ("", "", "no marks at all")


def test_sections():
    body = "start\n\n### One\n\na\n\nb\n\n## Two\n\n##### Deep\n\nc\n\n## Three\n\n#### Gone\n\n## Four\n\nd"
    assert [s["breadcrumb"] for s in split_sections(body)] == ["", "One", "Two > Deep", "Four"]
    assert split_sections(body)[1]["content"] == "### One  \na  \nb"
    assert split_sections("## x\n```\n## not a header\n```\ny")[0]["breadcrumb"] == "x"
    assert split_sections("") == [] == split_sections("## only\n\n### headers")
    assert split_sections("## A\none two")[0]["content"] == "## A\none two"


def test_guard_rail():
    first = " ".join(f"a{k}" for k in range(28))
    second = " ".join(f"b{k}" for k in range(29))
    header = "[Chủ đề: T | Mục: B | Nguồn: U]"
    assert guarded(f"## B\n\n{first}\n\n{second}", header, whitespace_tokens, 70) == [f"## B\n\n{first}", second]
    assert recursive_split("a b c d e", 2, whitespace_tokens) == ["a b", "c d", "e"]
    assert "".join(recursive_split("x" * 9, 2, len)) == "x" * 9


def test_chunks_and_ids(spark):
    long = "## B\n" + "\n".join(" ".join(f"w{k}" for k in range(30)) for _ in range(6))
    rows = chunk_articles(article(spark, ARTICLE, f"# SOURCE_URL: U\n# T\n{long}"), max_tokens=80).orderBy("article_slug", "chunk_idx").collect()
    first = [r for r in rows if r.article_slug == "s0"]
    assert [r.section_path for r in first] == PATHS
    for r in rows:
        name = f"{r.type}:{r.article_slug}:{r.chunk_idx}"
        assert r.id == str(uuid.uuid5(uuid.UUID(T.CHUNK_NAMESPACE), name))
        assert r.token_count == len(r.text.split()) <= 80
    parts = [r for r in rows if r.article_slug == "s1"]
    assert [r.split_part for r in parts] == [f"{k + 1}/{len(parts)}" for k in range(len(parts))]
    assert parts[0].text.startswith(f"[Chủ đề: T | Mục: B (phần 1/{len(parts)}) | Nguồn: U]\n\n")
    assert {r.section_path for r in parts} == {"B"}
    assert all(r.split_part is None for r in first)


def test_a_part_that_cannot_shrink_fails(spark):
    with pytest.raises(Exception, match="above the token cap"):
        chunk_articles(article(spark, "# SOURCE_URL: U\n# T\n## B\nx"), max_tokens=2).collect()


def test_articles_above_the_cap_are_listed_and_the_others_stay(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [ARTICLE, f"# SOURCE_URL: U\n# T\n## {long}\nx y z", f"# SOURCE_URL: U\n# T\n## B\n{long}\n{long}"]
    chunks = chunk_articles(article(spark, *texts), max_tokens=50, fail=False)
    good, failed = within_cap(chunks, 50)
    assert [(r.article_slug, r.n_over > 0, r.most_tokens > 50) for r in failed.collect()] == [("s1", True, True)]
    assert {r.article_slug for r in good.collect()} == {"s0", "s2"} and good.agg({"token_count": "max"}).first()[0] <= 50
    parts = article_chunks(article(spark, texts[2]), 50).orderBy("chunk_idx").collect()
    assert "".join("".join(p.content.split()) for p in parts) == "##B" + "".join(long.split()) * 2
    assert [p.section for p in parts] == [0] * len(parts) and len(parts) > 2
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_long_header_is_kept_and_counted_once_for_all_parts(spark):
    # Below a header above the cap the text is split down to letters: thousands of parts with a header of thousands of characters each.
    head, words = " ".join(f"header{k}" for k in range(600)), " ".join(f"word{k:04d}" for k in range(1000))
    asked = []

    def count(text):
        asked.append(len(text))
        return whitespace_tokens(text)

    count.adds_up = True
    body = f"lead\n## {head}\n{words}\n## B\n{words}"
    found = article_parts("T", "U", body, 400, count)
    assert sum(asked) < 100 * len(body) and sum(len(x) for s in found for x in (s[1], *s[4])) < 2 * len(body)
    assert found == article_parts("T", "U", body, 400, lambda text: len(text.split()))  # by whole texts
    assert [(s[0], s[2], s[3]) for s in found] == [(0, 0, 0), (1, 1, len(found[1][4])), (2, 1 + len(found[1][4]), len(found[2][4]))] and len(found[1][4]) > 8000
    chunks = chunk_articles(article(spark, f"# SOURCE_URL: U\n# T\n{body}", "# SOURCE_URL: U\n# T\n" + words), fail=False)
    wrong = chunks.where((F.col("token_count") != T.word_count(F.col("text"))) | (F.col("id") != T.chunk_id(F.col("type"), F.col("article_slug"), F.col("chunk_idx"))))
    assert wrong.count() == 0 and chunks.where("split_part is not null and section_path = ''").count() > 1
    first = chunks.where("article_slug = 's0'")
    assert [r.chunk_idx for r in first.select("chunk_idx").orderBy("chunk_idx").collect()] == list(range(sum(len(s[4]) for s in found)))
    assert sorted((r.article_slug, r.most_tokens) for r in within_cap(chunks)[1].collect()) == [("s0", 600 + 11)]


def test_scalars(spark):
    row = spark.range(1).select(
        T.normalised(F.lit(" **a**\u00a0 b\n")).alias("norm"),
        T.slug_from_url(F.lit("https://x.org/a/b//")).alias("slug"),
        T.passage_of(F.lit("[head [x] a")).alias("inner"),
        T.passage_of(F.lit("[h]\n\n" + "y" * 301)).alias("cut"),
        T.title_of(F.lit(" " + "z" * 41)).alias("title"),
        T.chunk_body(F.lit("h\n\nb\n\nc")).alias("body"),
        T.chunk_body(F.lit("plain")).alias("plain"),
        T.is_http_url(F.lit("javascript:x")).alias("js"),
        T.question_or_null(F.lit("\u00a0 hỏi ")).alias("good"),
        T.question_or_null(F.lit("x" * 1001)).alias("long"),
        T.question_or_null(F.lit(None).cast("string")).alias("none"),
        T.shown_score(F.lit(1.5)).alias("shown"),
        T.shown_score(F.lit(None).cast("double")).alias("hidden"),
        T.terms(F.lit("Cafe\u0301 phổ_biến x² !")).alias("terms"),
    ).first()
    assert (row.norm, row.slug, row.inner) == ("a b", "b", "a")
    assert row.cut == "y" * 300 + "…" and row.title == "z" * 40 + "…"
    assert (row.body, row.plain, row.js, row.good, row.long, row.none) == ("b\n\nc", "plain", False, "hỏi", None, None)
    assert (row.shown, row.hidden) == ("1.50", None)
    assert row.terms == ["café", "phổ_biến", "x²"]


def test_citations(spark):
    rows = spark.createDataFrame([("a [1][2] b [9] [0]", 2), ("", 1), ("none <b>", 1)], "text string, n int")
    found = rows.select(T.split_citations(F.col("text"), F.col("n")).alias("p")).collect()
    assert [(p.kind, p.n) for p in found[0].p if p.kind == "cite"] == [("cite", 1), ("cite", 2)]
    assert "".join(p.value for p in found[0].p) == "a [1][2] b [9] [0]"
    assert found[1].p == [] and [p.kind for p in found[2].p] == ["text"]


def test_a_large_input_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/articles"
    article(spark, *["# T\n\n" + " ".join(str(1000 * k + j) for j in range(500)) for k in range(300)]).coalesce(1).write.parquet(path, compression="none")
    monkeypatch.setattr(chunking, "PART_BYTES", 10_000)
    dealt = chunking.dealt(spark.read.parquet(path))
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert sum(sizes) == 300 and max(sizes) < 30


def test_stripped_takes_any_white_space_and_leaves_the_rest(spark):
    texts = ["", " ", "a", " a b ", " a ", "\na\r\n\n", None, "a\x85"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.stripped(F.col("t")).alias("s")).orderBy("k")
    assert [r["s"] for r in got.collect()] == ["", "", "a", "a b", "a", "a", None, "a"]
