import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chatlog, evaluate, prompts
from lodestone.operators import index as ix
from lodestone.operators.chunking import chunk_articles
from lodestone.plans import bindings, chat_queries, index_queries
from lodestone.sources.files import load_conversations, read_articles, read_qa_cases, save_conversations
from lodestone.streaming.ingest import incremental_ingest


def text(title, *sections):
    return f"# SOURCE_URL: https://x.org/{title}/\n\n# {title}\n\n**intro**\n\n" + "\n\n".join(f"## {s}\n\nbody {s}" for s in sections)


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), "article_type string, article_slug string, text string")


def test_replace_counts_five_three_three_two(spark):
    index = chunk_articles(articles(spark, ("drug", "a", text("a", "x", "y")), ("disease", "b", text("b", "z"))))
    assert index.count() == 5
    key_a = articles(spark, ("drug", "a", "")).select(F.col("article_type").alias("type"), "article_slug")
    shorter = ix.replace_articles(index, key_a, chunk_articles(articles(spark, ("drug", "a", "# SOURCE_URL: u\n# a\nonly"))))
    assert shorter.count() == 3
    again = ix.replace_articles(shorter, key_a, chunk_articles(articles(spark, ("drug", "a", "# SOURCE_URL: u\n# a\nonly"))))
    assert again.count() == 3
    assert ix.replace_articles(again, key_a, index.limit(0)).count() == 2


def test_stored_replacement_and_stream(spark, tmp_path):
    path = f"file://{tmp_path}"
    first = articles(spark, ("drug", "a", text("a", "x", "y")), ("disease", "b", text("b", "z")))
    ix.write_index(chunk_articles(first), f"{path}/index")
    later = articles(spark, ("drug", "a", text("a", "x")), ("disease", "b", "")).withColumn("delivered_at", F.lit(5).cast("long"))
    older = articles(spark, ("drug", "a", text("a", "o", "l", "d"))).withColumn("delivered_at", F.lit(1).cast("long"))
    later.unionByName(older).write.parquet(f"{path}/incoming")
    for run in ("one", "two"):
        incremental_ingest(spark, f"{path}/incoming", f"{path}/index", f"{path}/{run}")
        found = ix.read_index(spark, f"{path}/index")
        assert sorted((r.article_slug, r.section_path) for r in found.collect()) == [("a", ""), ("a", "x")]


def test_older_deliveries_in_later_batches_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    ix.write_index(chunk_articles(articles(spark, ("drug", "a", text("a", "x", "y")), ("drug", "b", text("b", "z")))), f"{path}/index")
    same = sorted(("p", "q"), key=lambda s: hashlib.sha256(text("c", s).encode()).digest(), reverse=True)
    deliveries = [("a", text("a", "new"), 5), ("b", "", 5), ("a", text("a", "old"), 1), ("b", text("b", "old"), 4), *(("c", text("c", s), 7) for s in same)]
    for slug, body, at in deliveries:
        one = articles(spark, ("drug", slug, body)).withColumn("delivered_at", F.lit(at).cast("long"))
        one.coalesce(1).write.mode("append").parquet(f"{path}/incoming")
    incremental_ingest(spark, f"{path}/incoming", f"{path}/index", f"{path}/run", files_per_batch=1)
    found = sorted((r.article_slug, r.section_path) for r in ix.read_index(spark, f"{path}/index").collect())
    assert found == [("a", ""), ("a", "new"), ("c", ""), ("c", same[0])]


def test_failed_articles_stay_out(spark):
    rows = [("t", "ok", "1", [1.0, 2.0]), ("t", "bad", "2", [1.0]), ("t", "bad", "3", [1.0, 2.0]), ("t", "none", "4", None)]
    chunks = spark.createDataFrame(rows, "type string, article_slug string, id string, dense array<float>")
    good, failed = ix.isolate_failed(chunks, 2)
    assert [r.id for r in good.collect()] == ["1"]
    assert sorted((r.article_slug, r.n_chunks, r.n_valid) for r in failed.collect()) == [("bad", 2, 1), ("none", 1, 0)]


def test_invariants(spark):
    expected = spark.createDataFrame([("1", "t", "a", True), ("2", "t", "a", True), ("3", "t", "b", False)], "id string, type string, article_slug string, has_terms boolean")
    rows = [("1", "t", "a", [1.0], "s"), ("1", "t", "a", [1.0], "s"), ("3", "t", "c", [1.0, 2.0], "s"), ("4", "t", "a", [1.0], None)]
    index = spark.createDataFrame(rows, "id string, type string, article_slug string, dense array<double>, sparse string")
    found = sorted((r.id, r.problem) for r in ix.invariant_problems(expected, index, 1).collect())
    assert found == [("1", "duplicate"), ("2", "missing"), ("3", "dimension"), ("3", "payload"), ("3", "sparse"), ("4", "unexpected")]
    assert not ix.schema_report(index, 1).first().ok


def test_metrics(spark):
    cases = spark.createDataFrame([(1, "t", "a", "x  **y**"), (2, "t", "b", None)], "case_id long, type string, article_slug string, context string")
    hits = spark.createDataFrame([("m", 1, 1, "t", "z", "x y"), ("m", 1, 2, "t", "a", "no")], "mode string, case_id long, rank int, hit_type string, hit_slug string, text string")
    records = evaluate.first_hits(cases, hits)
    assert sorted((r.case_id, r.article_rank, r.chunk_rank) for r in records.collect()) == [(1, 2, 1), (2, None, None)]
    summary = {r.type: r for r in evaluate.eval_summary(records).collect()}
    assert (summary["all"].n, summary["all"].article_at_k, summary["t"].mrr) == (2, 0.5, 0.5)


def test_prompt_and_no_hits(spark):
    asked = spark.createDataFrame([(1, "đau đầu là gì?"), (2, "?")], "question_id long, question string")
    rows = [(1, 1, "c1", "Bài 1", "u1", "Mục 1", "disease", "[T1]\n\nA.", 0.5), (1, 2, "c2", "Bài 2", "u2", "", "drug", "B.", None)]
    hits = spark.createDataFrame(rows, "question_id long, rank int, chunk_id string, article_title string, article_url string, section_path string, type string, text string, score double")
    out = {r.question_id: r for r in prompts.answer_rows(asked, hits).collect()}
    assert out[1].messages[1].content == "Tài liệu:\n[1] Bài 1 — Mục 1\n[T1]\n\nA.\n\n[2] Bài 2 — \nB.\n\nCâu hỏi: đau đầu là gì?"
    assert [s.n for s in out[1].sources] == [1, 2] and out[1].sources[1].score is None and out[1].answer is None
    assert out[2].answer == prompts.NO_RESULT and out[2].sources == [] and out[2].messages is None


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents 1 to 12 of five lines each, and a question on each of the first four and on nothing."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, "en", "\n".join(f"w{k}x{i} common" for i in range(5))) for k in range(1, 13)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    asked = [(k, f"w{k}x0 w{k}x1") for k in range(1, 5)] + [(5, "nowhere")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_prompt_queries_search_every_question(spark, tables, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    out = {r.question_id: r for r in chat_queries.answer_rows(spark, tables).collect()}
    assert {k: r.n_sources for k, r in out.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    assert [k for k, r in out.items() if r.answer == prompts.NO_RESULT] == [5]


def test_status_queries_see_every_article(spark, tables):
    status = index_queries.isolate_failed_articles(spark, tables).collect()
    assert sorted((int(r.article_slug), r.n_chunks, r.ok) for r in status) == [(k, 2, True) for k in range(1, 13)]
    report = index_queries.ingest_report(spark, tables).first()
    assert (report.articles_ok, report.expected_chunks, report.index_points) == (12, 24, 24)
    assert index_queries.good_chunks(spark, tables).count() == 24


def test_contexts_are_whole_texts_also_without_an_article(spark, tmp_path):
    whole = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, "en", whole)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, whole), (99, whole)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cases = bindings.qa_contexts(spark, str(tmp_path))
    assert sorted((r.case_id, r.type, r.context) for r in cases.collect()) == [(1, "en", whole), (99, None, whole)]
    hit = spark.createDataFrame([("m", 1, 1, "en", "1", "one two three four five six seven eight")], "mode string, case_id long, rank int, hit_type string, hit_slug string, text string")
    records = evaluate.first_hits(cases, hit)
    assert sorted((r.case_id, r.article_rank, r.chunk_rank) for r in records.collect()) == [(1, 1, None), (99, None, None)]


def test_chat_log(spark):
    rows = [("c", 0, "m0", "hỏi", None, 10), ("c", 1, "m1", "đáp", ["s1"], 11), ("c", 3, "m3", "lỗi", None, 12)]
    log = spark.createDataFrame(rows, "conv_id string, turn int, msg_id string, text string, sources array<string>, created_at long")
    patches = spark.createDataFrame([("c", "m1", "mới"), ("d", "m1", "x")], "conv_id string, msg_id string, text string")
    patched = {r.msg_id: r.text for r in chatlog.apply_patches(log, patches).collect()}
    assert patched == {"m0": "hỏi", "m1": "mới", "m3": "lỗi"}
    none = log.limit(0).select("conv_id", "msg_id")
    assert chatlog.sources_for(log, none).first().sources == ["s1"]
    midnight = 1_700_006_400_000
    days = spark.createDataFrame([("a", midnight), ("b", midnight - 1)], "conv_id string, created_at long")
    assert {r.conv_id: r.day for r in chatlog.group_by_day(days, midnight + 5).collect()} == {"a": "today", "b": "previous"}


def test_histories(spark):
    good = json.dumps([{"id": "1", "title": "t", "createdAt": 1, "messages": [{"id": "m", "role": "user", "text": "x"}, {"id": "p", "role": "assistant", "text": "", "pending": True}]}])
    raw = spark.createDataFrame([(good,), ("{broken",), ('{"id": "1"}',), (None,)], "raw string")
    loaded = raw.select(load_conversations(F.col("raw")).alias("h"))
    assert [len(r.h) for r in loaded.collect()] == [1, 0, 0, 0]
    saved = loaded.select(load_conversations(save_conversations(F.col("h"))).alias("h")).first().h
    assert [m.id for m in saved[0].messages] == ["m"]


def test_files(spark, tmp_path):
    (tmp_path / "drug").mkdir()
    (tmp_path / "drug" / "thuoc-a.txt").write_text("dòng 1\ndòng 2", encoding="utf-8")
    assert [tuple(r) for r in read_articles(spark, str(tmp_path)).collect()] == [("drug", "thuoc-a", "dòng 1\ndòng 2")]
    cases = tmp_path / "cases"
    cases.mkdir()
    (cases / "drug.csv").write_text('question,answer,context,article_url\nq,"a ""b""\nc",ctx,u\n', encoding="utf-8")
    (cases / "empty.csv").write_text("question,answer,context,article_url\n", encoding="utf-8")
    rows = read_qa_cases(spark, str(cases)).collect()
    assert [(r.article_type, r.answer) for r in rows] == [("drug", 'a "b"\nc')]


def test_numbering_equals_one_window(spark):
    from lodestone.operators.chatlog import numbered

    rows = spark.createDataFrame([("a" if k % 5 else "b", k % 7, k) for k in range(300)], "day string, at long, id long")
    got = numbered(rows, "day", [F.desc("at"), F.asc("id")], "n").collect()
    for day in "ab":
        want = sorted(((-r.at, r.id) for r in got if r.day == day))
        assert [(-r.at, r.id) for r in sorted((r for r in got if r.day == day), key=lambda r: r.n)] == want
        assert sorted(r.n for r in got if r.day == day) == list(range(1, len(want) + 1))


def test_embedding_counts_failures_and_builds_an_index(spark, tmp_path):
    from lodestone.operators import index as ix
    from lodestone.operators.build import build_index
    from lodestone.operators.embed import embedded

    def connect():
        def embed(texts, task):
            assert len(texts) <= 4
            if any("raise" in t for t in texts):
                raise OSError("no answer")
            return [[1.0, 2.0] for t in texts if "drop" not in t] if task == "document" else [[0.0, float("nan")]] * len(texts)

        return embed

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "raise", None, "drop", "b", "c"])], "k int, embed_input string").coalesce(1)
    one = {r.k: r.dense for r in embedded(rows, connect, 2, batch=1).collect()}
    assert one == {0: [1.0, 2.0], 1: None, 2: None, 3: None, 4: [1.0, 2.0], 5: [1.0, 2.0]}
    together = {r.k: r.dense for r in embedded(rows, connect, 2, batch=4).collect()}
    assert together == {0: None, 1: None, 2: None, 3: None, 4: None, 5: [1.0, 2.0]}
    assert all(r.dense is None for r in embedded(rows, connect, 2, task="query", batch=1).collect())

    def connect_one():
        return lambda texts, task: [[float(len(t)), 1.0] if "broken" not in t else [0.0] for t in texts]

    def delivery(*texts):
        return spark.createDataFrame([("01", f"s{k}", f"# SOURCE_URL: u\n# T\n{t}") for k, t in texts], "article_type string, article_slug string, text string")

    path = f"file://{tmp_path}"
    long = "w " * 60
    built = build_index(delivery((0, "eins zwei\n## A\ndrei"), (1, "broken"), (2, f"## {long}\nx")), f"{path}/index", connect_one, 2, max_tokens=40, postings_path=f"{path}/postings")
    assert sorted((r.article_slug, r.reason) for r in built.failures.collect()) == [("s1", "embedding"), ("s2", "token cap")]
    report = built.report.first()
    assert (report.articles_ok, report.articles_failed, report.points_upserted, report.index_points) == (1, 2, 2, 2)
    index = ix.read_index(spark, f"{path}/index")
    assert {(r.type, r.article_slug, len(r.dense), len(r.sparse) > 0) for r in index.collect()} == {("01", "s0", 2, True)}
    assert ix.schema_differences(index, index.schema) == [] and ix.schema_differences(index.drop("dense"), index.schema)
    again = build_index(delivery((0, "vier"), (1, "fixed")), f"{path}/index", connect_one, 2, max_tokens=40, postings_path=f"{path}/postings", recreate=False)
    assert again.report.first().index_points == 2
    assert {r.article_slug for r in ix.read_index(spark, f"{path}/postings").collect()} == {"s0", "s1"}
