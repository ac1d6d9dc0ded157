"""The stored index: split leaves, generations, updates with vectors, streams of article files."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as ix
from lodestone.operators import store
from lodestone.operators.build import Recipe, build_index, index_frequencies, index_stats, keyed_postings, update_index
from lodestone.operators.chunking import chunk_articles
from lodestone.operators.embed import CallPolicy, embedded
from lodestone.sources.files import article_names, read_articles, read_qa_cases, type_folders, write_articles
from lodestone.sources.tables import scratch, temporary
from lodestone.streaming import ingest


def body(title, *sections):
    return f"# SOURCE_URL: https://x.org/{title}/\n\n# {title}\n\nintro\n\n" + "\n\n".join(f"## {s}\n\nbody {s}" for s in sections)


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), "article_type string, article_slug string, text string")


def _connector():
    def connect():  # not of this module, which workers cannot import
        def embed(texts, task):
            if any("raise" in t for t in texts):
                raise OSError("no answer")
            return [[float(len(t)), 1.0] if "short" not in t else [0.0] for t in texts]

        return embed

    return connect


connect = _connector()
QUICK = CallPolicy(attempts=1)


def recipe(**more):
    return Recipe(connect, 2, policy=QUICK, **more)


def contents(s):
    """What an index says, whatever generation and leaves it is in."""
    rows = s.table("chunks").collect()
    chunks = sorted((r["type"] or "", r["article_slug"], r["chunk_idx"], r["text"], tuple(r["dense"]), tuple(x["term_index"] for x in r["sparse"])) for r in rows)
    postings = sorted(tuple(r) for r in s.table("postings").select("id", "term_index", "tf", "dl").collect())
    terms = sorted(tuple(r) for r in index_frequencies(s).collect())
    return chunks, postings, terms, tuple(index_stats(s).first())


def rows_of(spark, n, start=0):
    return spark.range(start, start + n).select(F.lit("t").alias("type"), F.col("id").cast("string").alias("article_slug"), F.col("id").alias("v"))


def slugs(s):
    return sorted(int(r[0]) for r in s.table("chunks").select("article_slug").collect())


def test_leaves_split_and_one_article_rewrites_one_small_leaf(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = store.create(spark, path, {"chunks": rows_of(spark, 100)}, split_rows=40)
    assert len(s.leaves) == 4 and sum(leaf.rows for leaf in s.leaves) == 100 and {len(leaf.prefix) for leaf in s.leaves} == {2}
    for start in range(100, 1000, 300):
        new = rows_of(spark, 300, start)
        s = store.replace(s, {"chunks": store.Change(new, new)})
    assert slugs(s) == list(range(1000)) and max(leaf.rows for leaf in s.leaves) <= 80
    prefixes = sorted(leaf.prefix for leaf in s.leaves)
    assert not any(b.startswith(a) for a, b in zip(prefixes, prefixes[1:])), "leaves do not overlap"
    assert sum(2.0 ** -len(p) for p in prefixes) == 1, "and leave nothing out"
    one = rows_of(spark, 1, 77).withColumn("v", F.lit(-1).cast("long"))
    after = store.replace(s, {"chunks": store.Change(one, one)})
    rewritten = set(after.leaves) - set(s.leaves)
    assert len(rewritten) == 1 and next(iter(rewritten)).rows <= 80
    assert {r["v"] for r in after.table("chunks").where("article_slug = '77'").collect()} == {-1} and after.rows("chunks") == 1000


def test_rows_that_lie_by_their_hash_are_not_shuffled(spark, tmp_path, monkeypatch):
    path, parts = f"file://{tmp_path}/s", 7
    lying = lambda rows: rows.repartitionById(parts, store.place(parts, *store.KEY))
    ranges = rows_of(spark, 400).select(store.place(parts, *store.KEY).alias("p"), F.expr("lpad(bin(xxhash64(type, article_slug)), 64, '0')").alias("b")).orderBy("b").collect()
    assert [r["p"] for r in ranges] == sorted(r["p"] for r in ranges) and {r["p"] for r in ranges} == set(range(parts))
    frame = type(rows_of(spark, 1))
    monkeypatch.setattr(frame, "hint", lambda self, name, *by: pytest.fail(f"{name} of rows that lie where they belong"))
    s = store.create(spark, path, {"chunks": lying(rows_of(spark, 400))}, split_rows=40, placed=("chunks",))
    assert slugs(s) == list(range(400)) and len(s.leaves) == 16
    new = lying(rows_of(spark, 100, 350))
    s = store.replace(s, {"chunks": store.Change(new, new.withColumn("v", -F.col("v")))}, placed=("chunks",))
    assert {int(r["article_slug"]): r["v"] for r in s.table("chunks").collect()} == {k: -k if k >= 350 else k for k in range(450)}
    assert all(s.read([leaf], "chunks").count() == leaf.rows for leaf in s.leaves)


def test_readers_see_one_generation(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    first = store.create(spark, path, {"chunks": rows_of(spark, 20)})
    reader = ix.opened(spark, path)
    table = reader.table("chunks")
    store.replace(first, {"chunks": store.Change(rows_of(spark, 5), rows_of(spark, 0))})
    assert table.count() == 20 and reader.table("chunks").count() == 20
    assert slugs(ix.opened(spark, path)) == list(range(5, 20))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # a second writer of the same generation
        store.replace(first, {"chunks": store.Change(rows_of(spark, 1, 9), rows_of(spark, 0))})
    assert store.vacuum(spark, path, keep=2) == 1 and table.count() == 20  # what the second writer has left
    assert store.vacuum(spark, path, keep=1) > 0
    assert slugs(ix.opened(spark, path)) == list(range(5, 20)) and store.snapshot(spark, path, 1) is None


def test_a_failed_change_is_never_seen(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = store.create(spark, path, {"chunks": rows_of(spark, 20)})
    bad = rows_of(spark, 20).withColumn("v", F.when(F.col("v") == 7, F.raise_error(F.lit("stop")).cast("long")).otherwise(-F.col("v")))
    with pytest.raises(Exception, match="stop"):
        store.replace(s, {"chunks": store.Change(rows_of(spark, 20), bad)})
    now = ix.opened(spark, path)
    assert now.generation == 1 and {r["v"] >= 0 for r in now.table("chunks").collect()} == {True}
    again = rows_of(spark, 2)
    assert store.replace(now, {"chunks": store.Change(again, again)}).rows("chunks") == 20


def test_types_nulls_and_other_schemas(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = spark.createDataFrame([("01", "a", 1), ("a=b/ü", "a", 2), (None, "a", 3), ("01", None, 4)], "type string, article_slug string, v long")
    s = store.create(spark, path, {"chunks": rows})
    assert sorted(r["v"] for r in s.table("chunks").collect()) == [1, 2, 3, 4]
    assert sorted(r["v"] for r in s.table("chunks", ["01"]).collect()) == [1, 4]
    keys = rows.where("v in (3, 4)")
    after = store.replace(s, {"chunks": store.Change(keys, keys.withColumn("v", F.col("v") * 10))})
    assert sorted(r["v"] for r in after.table("chunks").collect()) == [1, 2, 30, 40]
    with pytest.raises(store.IndexMismatch, match="v: string instead of bigint"):
        store.replace(after, {"chunks": store.Change(keys, keys.withColumn("v", F.lit("x")))})
    with pytest.raises(store.IndexMismatch, match="w: int instead of nothing"):
        store.replace(after, {"chunks": store.Change(keys, keys.withColumn("w", F.lit(1)))})
    empty = store.create(spark, f"file://{tmp_path}/e", {"chunks": rows.limit(0)})
    assert empty.table("chunks").count() == 0
    assert store.replace(empty, {"chunks": store.Change(rows, rows)}).rows("chunks") == 4
    with pytest.raises(FileNotFoundError):
        ix.opened(spark, f"file://{tmp_path}/nothing")
    vectors = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0])], "id string, dense array<float>")
    assert ix.checked(vectors, vectors.schema) is vectors
    with pytest.raises(ix.IndexMismatch, match="dense: missing instead of array<float>"):
        ix.checked(vectors.drop("dense"), vectors.schema)
    with pytest.raises(ix.IndexMismatch, match="1 to 2 numbers instead of 2"):
        ix.checked(vectors, vectors.schema, 2)


def test_update_with_vectors_equals_a_rebuild(spark, tmp_path):
    """The probes of a built index: vectors, an article above the cap, failing texts, and leaves of any number."""
    base, long = f"file://{tmp_path}", "w " * 500
    first = [("d", f"s{k}", body(f"s{k}", "x", "y")) for k in range(20)]
    build_index(articles(spark, *first), f"{base}/index", connect, 2, split_rows=8, policy=QUICK)
    s = ix.opened(spark, f"{base}/index")
    assert len(s.of("chunks")) > 4
    delivery = [
        ("d", "s1", body("s1", "new")), ("d", "s2", ""), ("d", "s3", body("s3", "raise")), ("d", "s4", body("s4", "short")),
        ("d", "s5", f"# SOURCE_URL: u\n# t\n## {long}\nx"), ("e", "n", body("n", "z")),
    ]
    p, s = update_index(s, articles(spark, *delivery), recipe())
    good = {"s1", "s2", "n"}
    now = [r for r in first if r[1] not in good] + [r for r in delivery if r[1] in good]
    build_index(articles(spark, *now), f"{base}/again", connect, 2, policy=QUICK)
    assert contents(s) == contents(ix.opened(spark, f"{base}/again"))
    quarantine = {r["article_slug"]: r["reason"] for r in s.table("quarantine").collect()}
    assert quarantine == {"s3": "embedding", "s4": "embedding", "s5": "token cap"}
    assert s.table("articles").count() == 21
    _, s = update_index(s, articles(spark, ("d", "s3", body("s3", "works")), ("d", "s5", "")), recipe())
    assert {r["article_slug"] for r in s.table("quarantine").collect()} == {"s4"}
    assert "s5" not in {r["article_slug"] for r in s.table("chunks").collect()}
    with pytest.raises(store.IndexMismatch, match="dense: missing"):
        update_index(s, articles(spark, *delivery[:1]), Recipe())


def test_counts_by_differences_stay_right_through_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_DELTAS", 2)
    base = f"file://{tmp_path}"
    build_index(articles(spark, *[("d", f"s{k}", body(f"s{k}", "x")) for k in range(4)]), f"{base}/index", connect, 2, policy=QUICK)
    s = ix.opened(spark, f"{base}/index")
    for n in range(2):
        with temporary(spark):
            _, s = update_index(s, articles(spark, ("d", f"s{n % 3}", body(f"s{n % 3}", *"abc"[: n % 4])), ("d", f"n{n}", body(f"n{n}", "q"))), recipe())
        postings = keyed_postings(s.table("chunks"))
        want = sorted(tuple(r) for r in postings.groupBy("term_index").agg(F.count(F.lit(1)).alias("n")).collect())
        assert sorted(tuple(r) for r in index_frequencies(s).collect()) == want
        n_chunks, avgdl = index_stats(s).first()
        assert n_chunks == s.table("chunks").count() == s.rows("chunks")
        assert avgdl * n_chunks == pytest.approx(postings.agg(F.sum("tf")).first()[0])
    assert len(s.of("terms")) <= 2


def put(root, kind, slug, text, at):
    folder = root / kind
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{slug}.txt").write_text(text, encoding="utf-8")
    os.utime(folder / f"{slug}.txt", (at, at))


def test_article_files_out_of_order_restart_and_removal(spark, tmp_path):
    base, root = f"file://{tmp_path}", tmp_path / "in"
    now = 1_700_000_000
    build_index(articles(spark, ("d", "a", body("a", "x", "y")), ("d", "b", body("b", "z"))), f"{base}/index", connect, 2, policy=QUICK)

    def run():
        ingest.ingest_files(spark, f"{base}/in/*", f"{base}/index", f"{base}/run", recipe(), files_per_batch=2)

    put(root / "1", "d", "a", body("a", "new"), now + 50)
    put(root / "1", "d", "thuốc 100%+", body("c", "m"), now)
    run()
    put(root / "2", "d", "a", body("a", "old"), now + 10)  # arrives later, but was written before
    put(root / "2", "d", "b", body("b", "raise"), now + 60)
    put(root / "2", "e", "long", f"# SOURCE_URL: u\n# t\n## {'w ' * 500}\nx", now + 61)
    run()
    put(root / "3", "e", "q", body("q", "1"), now + 70)
    run()
    s = ix.opened(spark, f"{base}/index")
    assert {r["article_slug"]: r["reason"] for r in s.table("quarantine").collect()} == {"b": "embedding", "long": "token cap"}
    generation = s.generation
    run()
    assert ix.opened(spark, f"{base}/index").generation == generation, "nothing new, nothing written"
    (root / "3" / "e" / "q.txt").unlink()
    present = article_names(spark, f"{base}/in/*").unionByName(articles(spark, ("d", "b", "")).drop("text"))
    assert ingest.remove_missing(spark, present, f"{base}/index", recipe(), now_ms=now * 1000 + 99_000) == 1
    want = [("d", "a", body("a", "new")), ("d", "b", body("b", "z")), ("d", "thuốc 100%+", body("c", "m"))]
    build_index(articles(spark, *want), f"{base}/again", connect, 2, policy=QUICK)
    assert contents(ix.opened(spark, f"{base}/index")) == contents(ix.opened(spark, f"{base}/again"))


def test_batches_of_files_grow_with_the_index(spark, tmp_path, monkeypatch):
    base, now = f"file://{tmp_path}", 1_700_000_000
    monkeypatch.setattr(ingest, "FILES_PER_BATCH", 2)
    for name, n, generations in (("large", 40, 1), ("small", 6, 3)):
        build_index(articles(spark, *[("d", f"s{k}", body(f"s{k}", "x")) for k in range(n)]), f"{base}/{name}", connect, 2, policy=QUICK)
        for k in range(6):
            put(tmp_path / f"in-{name}" / "1", "d", f"s{k}", body(f"s{k}", "y"), now + k)
        if name == "large":  # neither lies as an article does
            put(tmp_path / f"in-{name}", "1", "stray", body("stray", "y"), now)
            put(tmp_path / f"in-{name}" / "1" / "d", "deep", "er", body("er", "y"), now)
        ingest.ingest_files(spark, f"{base}/in-{name}/*", f"{base}/{name}", f"{base}/run-{name}", recipe())
        s = ix.opened(spark, f"{base}/{name}")
        assert s.generation == 1 + generations
        assert s.rows("articles") == n and s.table("chunks").where("text like '%body y%'").count() == 6


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    base = f"file://{tmp_path}"
    build_index(articles(spark, ("d", "a", body("a", "x"))), f"{base}/index", connect, 2, policy=QUICK)
    new = articles(spark, ("d", "a", body("a", "y")))
    for _ in range(2):
        ingest.update_from_stream(spark, f"{base}/index", new, recipe(), "stream", 0)
    s = ix.opened(spark, f"{base}/index")
    assert s.generation == 2 and s.meta["batches"] == {"stream": 0}
    ingest.update_from_stream(spark, f"{base}/index", new, recipe(), "other", 0)
    assert ix.opened(spark, f"{base}/index").meta["batches"] == {"stream": 0, "other": 0}


def test_old_state_is_dropped():
    class State:
        def __init__(self, value=None, timed_out=False):
            self.value, self.hasTimedOut, self.timeout = value, timed_out, None

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def remove(self):
            self.value = None

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.timeout = ms

    import pandas as pd

    frame = pd.DataFrame({"delivered_at": [3, 5, 5, 4], "delivered_hash": ["a", "b", "c", "z"], "text": list("abcz"), "deleted": [False] * 4})
    state = State()
    out = list(ingest.newest(("d", "s"), [frame.iloc[:2], frame.iloc[2:]], state, 9))
    assert out[0]["text"].tolist() == ["c"] and state.value == (5, "c") and state.timeout == 9
    assert list(ingest.newest(("d", "s"), [frame], state, 9)) == []
    state.hasTimedOut = True
    assert list(ingest.newest(("d", "s"), [], state, 9)) == [] and state.value is None


def test_names_of_files_are_decoded(spark, tmp_path):
    rows = [("thuốc a", "x+y"), ("50%", "a b"), ("%41", "ü%20"), ("plain", "dấu")]
    made = articles(spark, *[(k, s, f"{k}/{s}") for k, s in rows])
    write_articles(made, f"file://{tmp_path}/files")
    back = read_articles(spark, f"{tmp_path}/files")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in made.collect())
    assert sorted(tuple(r) for r in article_names(spark, f"{tmp_path}/files").collect()) == sorted(rows)
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "thuốc 1+%.csv").write_text("question,answer,context,article_url\nq,a,c,u\n", encoding="utf-8")
    assert read_qa_cases(spark, f"{tmp_path}/cases").first()["article_type"] == "thuốc 1+%"


def test_article_files_are_listed_by_folder(spark, tmp_path):
    for folder in ("drug", "a[b]{c}"):
        os.mkdir(f"{tmp_path}/{folder}")
        for name in ("one.txt", "two.txt", "other.md"):
            with open(f"{tmp_path}/{folder}/{name}", "w") as f:
                f.write(f"{folder} {name}")
    with open(f"{tmp_path}/stray.txt", "w") as f:
        f.write("not below a type")
    assert len(type_folders(spark, f"file://{tmp_path}")) == 2  # and not a path for each file
    want = sorted((k, s, f"{k} {s}.txt") for k in ("drug", "a[b]{c}") for s in ("one", "two"))
    assert sorted(tuple(r) for r in read_articles(spark, f"file://{tmp_path}").collect()) == want
    assert sorted(tuple(r) for r in article_names(spark, f"file://{tmp_path}").collect()) == [w[:2] for w in want]


def test_calls_are_tried_again_and_halved(spark, tmp_path):
    calls = tmp_path / "calls"

    def flaky():
        def embed(texts, task):
            with calls.open("a") as f:
                f.write(f"{len(texts)}\n")
            if calls.read_text().count("\n") == 1:
                raise OSError("once")
            if len(texts) > 2 or any("bad" in t for t in texts):
                raise TimeoutError("too much")
            return [[1.0, 2.0]] * len(texts)

        return embed

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "bad", "c"])], "k int, embed_input string").coalesce(1)
    found = {r["k"]: r["dense"] for r in embedded(rows, flaky, 2, policy=CallPolicy(attempts=2, pause=0.01)).collect()}
    assert found == {0: [1.0, 2.0], 1: [1.0, 2.0], 2: None, 3: [1.0, 2.0]}
    assert calls.read_text().split() == ["4", "4", "2", "2", "2", "1", "1", "1"]

    def never():
        raise OSError("no connection")

    assert [r["dense"] for r in embedded(rows, never, 2, policy=QUICK).collect()] == [None] * 4


def test_intermediate_tables_are_removed(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    with temporary(spark):
        path = scratch(spark, "x")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:").replace("//", "/"))
