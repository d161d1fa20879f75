import numpy as np
import pytest

from fernwave.llm import shingles, simjoin


def hashes(words):
    raw = [w.encode() for w in words]
    return shingles.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


@pytest.mark.parametrize("length", [8, 9, 15, 16, 17, 23, 24, 31, 40, 63, 64])
def test_words_that_differ_in_their_first_bytes_only(length):
    out, count = hashes([f"{i:04d}".ljust(length, "x") for i in range(5000)])
    assert (count == 1).all() and len(np.unique(out)) == 5000


def test_equal_words_have_equal_hashes_wherever_they_lie():
    words = ["a", "wordlong", "wordlonger", "\u0441\u043b\u043e\u0432\u043e\u0444\u043e\u0440\u043c\u0430", "x" * 33]
    one, _ = hashes([" ".join(words)])
    two, _ = hashes(["- " + "  ".join(words).upper().replace("\u0421\u041b\u041e\u0412\u041e\u0424\u041e\u0420\u041c\u0410", words[3])])
    assert one.tolist() == two.tolist() and len(set(one.tolist())) == len(words)
    assert [len(x) for x in hashes([])] == [0, 0]


def test_long_words_with_other_heads_are_no_copies(spark):
    rows = [(i, f"{i:03d}" + "\u0436" * 7) for i in range(400)]
    got = simjoin.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(i, i, 0, 1) for i in range(400)]
