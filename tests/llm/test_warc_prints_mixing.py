import base64
import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprints as fp
from lodestone.llm import warc
from lodestone.llm.mixing import sample_to_targets, shares, with_probabilities
from lodestone.llm.warc import BundleReader, archive_folder, parse_records, read_bundles, read_records, write_bundles


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(4, "http://a.org/é x\r\n", "<p>eins</p>"), (2, "http://b.org", "<p>eins</p>"), (9, None, None), (8, "u", ""), (7, "u", "ü" * 9000), (7, "u", "ü" * 9000), (None, "u", "<p>eins</p>")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, bundle string")
    index = write_bundles(pages, archive_folder(spark))
    rows = read_bundles(index).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        html = next(h for i, _, h in PAGES if i == r.page_id) or ""
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("revisit", 2)
            continue
        same = [i for i, _, h in PAGES if (h or "") == html and i is not None]
        assert r.record_type == ("response" if r.page_id == min(same) else "revisit")
        assert r.refers_to == (None if r.page_id == min(same) else min(same))
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), b32(html))
        if r.record_type == "response":
            assert bytes(r.payload).decode() == html
    one = read_records(index.where("page_id = 4")).collect()
    assert [(r.page_id, r.record_type) for r in one] == [(4, "revisit")]
    assert read_bundles(write_bundles(pages.limit(0), archive_folder(spark))).collect() == []


def test_revisits_name_their_response(spark):
    pages = spark.createDataFrame([p for p in PAGES if p[0] in (2, 4)], "page_id long, url string, html string")
    index = {r.page_id: r for r in write_bundles(pages, archive_folder(spark)).collect()}
    row = index[4]
    found = [h for h, _, at, _ in parse_records(BundleReader(row.bundle).frame(row.frame)) if at == row.offset_in_frame]
    assert found[0]["WARC-Refers-To"] == f"<urn:uuid:{index[2].record_id}>"
    assert found[0]["WARC-Refers-To-Target-URI"] == "http://b.org"


def test_reading_back_is_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    r = np.random.Generator(np.random.PCG64(3))
    rows = [(k, f"u{k}", r.bytes(300_000).hex()) for k in range(12)] + [(99, None, "z" * 3_000_000)]
    index = write_bundles(spark.createDataFrame(rows, "page_id int, url string, html string"), archive_folder(spark))
    back = read_bundles(index)
    assert back.rdd.getNumPartitions() > 12
    assert {x.page_id: bytes(x.payload).decode() for x in back.collect()} == {k: h for k, _, h in rows}


def test_seek_table_maps_records_to_frames(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 20_000) for k in range(8)], "page_id long, url string, html string").coalesce(1)
    index = write_bundles(pages, archive_folder(spark))
    for row in index.collect():
        reader = BundleReader(row.bundle)
        assert len(reader.frames) >= 4 and reader.frames[row.frame][:2] == (row.frame_offset, row.frame_bytes)
        found = [h for h, _, at, n in parse_records(reader.frame(row.frame)) if (at, n) == (row.offset_in_frame, row.record_bytes)]
        assert found[0]["X-Page"] == str(row.page_id) and found[0]["WARC-Record-ID"] == f"<urn:uuid:{row.record_id}>"
    with open(row.bundle.removeprefix("file:"), "rb") as f:
        assert struct.unpack("<I", f.read()[-4:])[0] == 0x8F92EAB1


def test_neighbours_equal_brute_force(spark):
    r = np.random.Generator(np.random.PCG64(1))
    texts = {int(i): "".join(r.choice(list("abc dé\n"), size=int(n))) for i, n in zip(r.permutation(60), r.integers(0, 400, 60), strict=True)}
    texts[5], texts[6] = "", texts[7]
    rows = [(i, t or None, "x") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(5)
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    found = fp.neighbour_fingerprints(docs).collect()
    assert sorted(x.doc_id for x in found) == sorted(texts)
    prints = {i: fp.fingerprints([t.encode()])[0] for i, t in texts.items()}
    for x in found:
        t, n = texts[x.doc_id], texts[following[x.doc_id]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        changed = fp.fingerprints([edited.encode()])[0]
        assert (x.fingerprint, x.edited_fingerprint) == (fp.written(prints[x.doc_id]), fp.written(changed))
        assert x.near_edited == pytest.approx(fp.likeness([prints[x.doc_id]], [changed])[0])
        assert x.near_next == pytest.approx(fp.likeness([prints[x.doc_id]], [prints[following[x.doc_id]]])[0])
    assert fp.neighbour_fingerprints(docs.limit(0)).collect() == []
    assert [x.near_next for x in fp.neighbour_fingerprints(docs.where("doc_id = 7")).collect()] == [1.0]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_likeness_is_the_edit_distance():
    r = np.random.Generator(np.random.PCG64(2))
    pairs = [tuple(r.choice(list(b"ABCDE"), size=int(r.integers(1, 64))).astype(np.uint8).tobytes() for _ in range(2)) for _ in range(50)]
    got = fp._indel_likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([2 * slow_lcs(a, b) / (len(a) + len(b)) for a, b in pairs])
    assert fp.likeness([(3, b"AB", b"A")], [(12, b"AB", b"A")])[0] == 0


def test_sampled_shares_meet_given_targets(spark):
    rows = [(k, "w " * (1 + k % 7), ["a", "b", None][k % 3], ["x", "y"][k % 2], 1) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    targets = {"source": {"a": 2, "b": 1, "unknown": 1, "absent": 9}, "lang": {"x": 3, "y": 1}}
    wanted = {"a": 0.5, "b": 0.25, "unknown": 0.25, "x": 0.75, "y": 0.25}
    found = {r.name: r for r in shares(docs, targets=targets).collect()}
    for name, share in wanted.items():
        assert found[name].target == pytest.approx(share) == found[name].expected
        assert found[name].sampled == pytest.approx(share, abs=0.03)
    mixed = with_probabilities(docs, targets=targets)
    assert mixed.agg(F.max("prob")).first()[0] == pytest.approx(1)  # as many tokens as the targets allow
    asked = with_probabilities(docs, targets=targets, fraction=0.2)
    expected = asked.agg(F.sum(F.col("prob") * F.col("tokens"))).first()[0]
    assert expected == pytest.approx(0.2 * sum(1 + k % 7 for k in range(6000)), rel=1e-6)
    sampled = sample_to_targets(docs, targets=targets)
    assert sampled.columns == docs.columns
    assert sorted(r.doc_id for r in sampled.collect()) == sorted(r.doc_id for r in sample_to_targets(docs, targets=targets).collect())


def test_mixing_edges(spark):
    schema = "doc_id long, text string, source string, lang string, tokens int, prob double, weight string, `row` int, __prob int"
    empty = spark.createDataFrame([], schema)
    assert sample_to_targets(empty).collect() == [] and sample_to_targets(empty).columns == empty.columns
    rows = [(None, None, None, None), (1, "", "a", "x"), (1, "", "a", "x"), (2, "one two", "a", "x"), (2, "one two", "a", "x"), (3, "long " * 100_000, "b", "x")]
    docs = spark.createDataFrame([(*r, 1, 2.0, "w", 3, 4) for r in rows], schema)
    mixed = with_probabilities(docs).collect()
    assert len(mixed) == 6 and all(0 <= m.prob <= 1 for m in mixed)
    assert {m.tokens for m in mixed if m.id == 3} == {100_000}
    kept = sample_to_targets(docs)
    assert kept.columns == docs.columns and all(r.weight == "w" and r["__prob"] == 4 for r in kept.collect())


def test_small_cells_are_taken_whole_and_others_make_up_for_them(spark):
    rows = [(k, "w w w w", "rare" if k % 50 == 0 else "a", ["x", "y"][k // 50 % 2], 0) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    # 80 rare documents: half of the sample shall be rare, so 4 % at most could be sampled exactly.
    targets = {"source": {"rare": 1, "a": 1}}
    exact = {r.name: r for r in shares(docs, targets=targets, least=0.03).collect()}
    assert exact["rare"].expected == pytest.approx(0.5) and exact["rare"].fraction == pytest.approx(0.04)
    found = {r.name: r for r in shares(docs, targets=targets, least=0.1).collect()}
    mixed = with_probabilities(docs, targets=targets, least=0.1)
    assert mixed.where("source = 'rare'").agg(F.min("prob")).first()[0] == pytest.approx(1)
    assert 0.09 < found["rare"].fraction <= 0.1
    assert found["rare"].residual == pytest.approx(80 / (4000 * found["rare"].fraction) - 0.5)
    assert found["x"].residual == pytest.approx(0, abs=1e-3), "the other dimension still holds"
