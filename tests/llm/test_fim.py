import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """The contract said in plain loops: n, form, prefix, middle, output."""
    text = text or ""
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t\x0b\x0c\r ", "one", " one two", "one two  \n", "ünï çödé  x y z", "a\x00b \x00 c", "<P> x", "y <M>", "< P>a<", "a< S> <S",
    "😀 😀😀\n😀", "word " * 30_000, "x" * 200_000, "same text", "same text",
]


@pytest.mark.parametrize("copies", [7])
def test_like_plain_loops(spark, copies):
    rows = [(i, t) for i, t in enumerate(TEXTS * copies)] + [(None, "no id here"), (3, "an id twice"), (3, "an id twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fim.fill_in_middle(docs).collect()
    have = sorted((str(r["doc_id"]), r["n_units"], r["form"], str(r["prefix"]), str(r["middle"]), r["output"], r["restored"]) for r in got)
    want = sorted((str(i), n, f, str(p), str(m), o, t or "") for i, t in rows for n, f, p, m, o in [plainly(i, t)])
    assert have == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nab<PSM>é\x00", max_size=30), min_size=1, max_size=6), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 99))
def test_any_text_comes_back(texts, h1, h2, h4):
    import numpy as np
    import pyarrow as pa

    given_texts = pa.array(texts, pa.large_string()).cast(pa.large_binary())
    h = [np.full(len(texts), x, dtype=np.int64) for x in (h1, h2, 0, h4)]
    found = fim.rearranged(given_texts, h)
    assert found["n_units"].to_pylist() == [len(UNIT.findall(t)) for t in texts]
    assert fim.restored(found["output"], found["form"]).to_pylist() == [t.encode() for t in texts]


def test_other_columns_types_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "x y z", "kept", 5)], "id string, body string, `h0` string, `Output` int")
    got = fim.fill_in_middle(docs, "id", "body", fim_percent=100)
    assert got.columns == ["id", "h0", *fim.OUTPUTS]
    row = got.first()
    assert row["h0"] == "kept" and row["form"] != "plain" and row["restored"] == "x y z"
    assert fim.fill_in_middle(docs.where("false"), "id", "body").count() == 0
    assert fim.fill_in_middle(docs.select("body"), "body", "body").first()["restored"] == "x y z"
