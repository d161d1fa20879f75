import hashlib
import random
import re

import pytest

from fernwave.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("joined", ["-1", "10m"])
def test_matches_brute_force(spark, joined):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    g = random.Random(1)
    vocab = ["the", "The", "of", "ÜBER", "über", "x1", "Σας", "K", "word", "a"]
    text = lambda n: g.choice([" ", ", ", "\n"]).join(g.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 12, 13, 14, 40, 40])] + [(20, None), (21, "..."), (22, "alpha beta"), (23, text(13)), (7, "extra row of item seven")]
    docs = [(i, text(g.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, text(20) + " " + (items[k][1] or "") + " " + text(g.choice([0, 5, 400]))) for i, k in enumerate([4, 5, 6, 7, 8, 12])]
    docs += [(200, None), (201, ""), (202, "!!"), (203, "alpha BETA"), (204, "filler " * 20000)]
    d = spark.createDataFrame([(a, b, "k", 1) for a, b in docs], "doc_id long, text string, key string, length int")
    b = spark.createDataFrame([(a, b, "k") for a, b in items], "item_id long, text string, key string")
    got = sorted((tuple(r)[:6] for r in decontam.contamination(d, b).collect()), key=str)
    assert got == brute(docs, items)
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in got if not r[5])
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_hash_set_misses_no_key_whatever_its_size(spark):
    from pyspark.sql import functions as F

    windows = spark.range(40_000).select(F.lit(4).alias("k"), F.xxhash64("id").alias("key"))
    for most in (1 << 15, 1 << 24):
        table, ks = decontam.hash_set(windows, most)
        n = len(table) - 1
        assert ks == [4] and n == min(most, 1 << 20)
        one, two = decontam.slots_of(F.col("key"), n)
        assert all(table[r.a] and table[r.b] for r in windows.select(one.alias("a"), two.alias("b")).collect())
    assert sum(table) <= 80_000


def test_rows_with_one_doc_id_and_several_texts(spark):
    item = " ".join(f"q{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item), (1, "zz yy"), (1, "zz yy"), (None, item), (None, "x")], "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in got) == [("1", 2, 0, False), ("1", 2, 0, False), ("1", 13, 13, True), ("None", 1, 0, False), ("None", 13, 13, True)]


def test_every_copy_of_a_row_gives_one(spark, monkeypatch):
    monkeypatch.setattr(decontam, "COPIES", 3)
    item = " ".join(f"q{i}" for i in range(13))
    rows = [(1, item)] * 7 + [(1, item + " x " + item)] * 3 + [(2, "a")] * 4 + [(None, None)] * 5 + [(3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(7, item), (8, "q2 q3")], "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontam.contamination(docs, items).collect()), key=str)
    assert got == brute(rows, [(7, item), (8, "q2 q3")])
    assert decontam.decontaminate(docs, items).count() == 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (None, "c"), (1, "a b")], "doc_id long, text string")
    assert decontam.contamination(none, items).count() == 0
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in decontam.contamination(some, items).collect() if r.doc_id) == [(1, 2, 0)] * 2
    assert decontam.decontaminate(some, items).count() == 3
