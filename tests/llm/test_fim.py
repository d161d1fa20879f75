"""Fill-in-the-middle against a parser of units and plain slicing."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwave.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def expected(doc_id, text, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢😀 \t\n\r\x0b\x0c\x08\x0e\x00\x1f!\xa0\x85", max_size=40), max_size=6), st.lists(st.integers(0, 2**32 - 1), min_size=12, max_size=12))
def test_cuts_against_parser(texts, numbers):
    x, y = np.array(numbers[: len(texts)], np.int64), np.array(numbers[6 : 6 + len(texts)], np.int64)
    got = fim.cut_batch(pa.array(texts, pa.string()), [x, y])
    for k, t in enumerate(texts):
        units = UNIT.findall(t)
        ends = np.cumsum([0] + [len(u.encode()) for u in units])
        want = sorted((ends[x[k] % (len(units) + 1)], ends[y[k] % (len(units) + 1)]))
        assert [got.n[k], got.a[k], got.b[k]] == [len(units), *want]


def test_every_byte_is_told_apart():
    every = np.arange(256, dtype=np.uint8)
    marks = fim.whitespace(every.view("<u8").astype(np.uint64)).view(np.uint8)
    assert np.array_equal(np.flatnonzero(marks), [9, 10, 11, 12, 13, 32])


def test_whole_table(spark):
    long = "wörter und  \n" * 200_000 + "end"
    texts = [None, "", "   ", "one", " one two ", "a <P> b", "<M", "x<S>", long, "same text here", "same text here", "日本 語\tテキスト é"]
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)] + [(None, "no id at all", "n", 2), (9, "same text here", "n", 3)] + [(100 + k, f"w{k} " * (k % 9) + "z", "n", 4) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)  # names clash
    got = fim.transform(docs).collect()
    want = sorted((str(i), *expected(i, t)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    hashes = sorted((str(r.doc_id), r.restored_sha256) for r in fim.digests(fim.transform(docs)).collect())
    assert hashes == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)


@pytest.mark.parametrize("piece", ["<", "<P", "<P>"[1:], "S>", "<<", ">M<"])
def test_parts_that_look_like_control_strings(spark, piece):
    """Parts may end or begin in pieces of control strings; the output still comes apart at the right places."""
    docs = spark.createDataFrame([(k, f"{piece} {piece} {piece}x {piece}") for k in range(40)], "doc_id long, text string")
    made = fim.transform(docs, rate=100)
    assert made.filter("form = 'plain'").count() == 0
    back = made.select("doc_id", fim.restore(made.output, made.form).alias("text"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.transform(docs)).collect() == []
