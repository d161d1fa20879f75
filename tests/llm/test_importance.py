"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from fernwave.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    w = WORD.findall((text or "").translate(FOLD))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, longest=1, buckets=importance.BUCKETS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text, longest)[1]))
    for text in target:
        t.update(map(bucket, runs(text, longest)[1]))
    ss, tt, out = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        w, f = runs(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in map(bucket, f)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, len(w)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    n = len(able) * percent // 100
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[:n])]
    left = Counter(tuple(r[:4]) for r in out)
    left.subtract(Counter(r[:4] for r in drawn))
    return sorted(map(str, drawn + [(*r, None) for r, k in left.items() for _ in range(k)]))


def corpus(n=400, seed=5):
    g = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)] + ["Straße", "ÉTÉ", "日本"]
    return [(k, " ".join(g.choices(vocabulary, k=g.randint(0, 60)))) for k in range(n)], [" ".join(g.choices(vocabulary[:15], k=30)) for _ in range(20)]


def run(spark, docs, target, **how):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int").repartition(4)  # names clash
    b = spark.createDataFrame([(t, 0) for t in target], "text string, n int")
    return sorted(map(lambda r: str(tuple(r)), importance.resample(d, b, **how).collect()))


def test_against_brute_force(spark):
    docs, target = corpus()
    assert run(spark, docs, target) == brute(docs, target)


@pytest.mark.parametrize("percent", [0, 1, 50, 100])
def test_shares(spark, percent):
    docs, target = corpus(150)
    assert run(spark, docs, target, percent=percent) == brute(docs, target, percent)


def test_runs_and_few_buckets(spark):
    docs, target = corpus(150)
    assert run(spark, docs, target, longest=3, buckets=7) == brute(docs, target, longest=3, buckets=7)


def test_nulls_empty_and_long_texts(spark):
    docs, target = corpus(60)
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, "W1 w2, " * 100_000), (None, "w1 w2 w3 " * 10), (None, None)]
    assert run(spark, docs, [*target, None, ""]) == brute(docs, [*target, ""])
    assert run(spark, docs, []) == brute(docs, [])


def test_ties_and_repeated_rows(spark):
    """One doc_id and text hold nearly all rows, so that the cutoff falls among rows that are alike."""
    text = "alpha beta gamma delta " * 6
    docs = [(7, text)] * 90 + [(None, text)] * 60 + [(7, text + "more")] * 5 + [(k, text) for k in range(20, 40)]
    for percent in (3, 30, 70, 95):
        assert run(spark, docs, ["alpha beta"], percent=percent) == brute(docs, ["alpha beta"], percent)


def test_least_value(spark):
    rows = spark.createDataFrame([(v,) for v in [-5, -5, 0, 3, 3, 3, 10**12]], "v long")
    ends = (-5, 10**12)
    assert [importance.least_value(rows, rows.v, n, *ends) for n in range(1, 8)] == [-5, -5, 0, 3, 3, 3, 10**12]


def test_remembered_words_are_bounded():
    h = importance.Hashed(10)
    old, importance.REMEMBERED = importance.REMEMBERED, 4
    try:
        assert [h[b"%d" % k] for k in range(20)] == [zlib.crc32(b"%d" % k) % 10 for k in range(20)] and len(h) <= 4
    finally:
        importance.REMEMBERED = old


def test_empty_table(spark):
    assert run(spark, [], ["a"]) == []
