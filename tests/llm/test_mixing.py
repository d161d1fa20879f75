import math

import numpy as np
import pytest

from fernwave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, start long, source_no long"


def rows_of(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return mixing.mix(docs, **how).collect()


def test_permutations_are_bijections_and_differ_by_key():
    for n in (1, 2, 3, 7, 64, 1000):
        i = np.arange(n)
        a = mixing.permuted(i, np.full(n, n), np.full(n, 5, np.uint64))
        assert sorted(a.tolist()) == i.tolist()
    assert (a != mixing.permuted(i, np.full(n, n), np.full(n, 6, np.uint64))).any()


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([10, 1000], [3.0, 1.0]) == [30.0, 980.0]
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [1.0, 2.0]) == [0.0, 0.0]
    t = mixing.targets([5, 7, 900, 1, 0], [1.0, 2.0, 3.0, 1.0, 2.0])
    assert math.isclose(sum(t), 913) and all(x <= 3 * n + 1e-9 for x, n in zip(t, [5, 7, 900, 1, 0]))


@pytest.mark.parametrize("block,shard", [(8, 16), (128, 8192)])
def test_mix_meets_targets_and_repeats_itself(spark, block, shard):
    g = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(g.integers(0, 300))), f"s{int(g.integers(0, 4))}") for i in range(300)]
    rows += [(1000 + i, "word " * 50, None) for i in range(5)] + [(2000, None, "s1"), (2001, "", "only"), (2002, "x " * 30000, "s2"), (2003, "a b", "s0"), (2003, "a b", "s0")]
    got = rows_of(spark, rows, block=block, shard=shard)
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, rows_of(spark, rows, block=block, shard=shard)), key=str)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 2 * block
    assert sum(r["size"] for r in got) == pytest.approx(sum(rs[0].target for rs in by.values()))


def test_sizes_and_empty_tables(spark):
    got = rows_of(spark, [(1, "a b\tc \x0b d", "x")])
    assert got[0]["size"] == 3
    assert rows_of(spark, []) == []
    assert [r.taken for r in rows_of(spark, [(1, None, "x"), (2, " ", None)])] == [0, 0]


@pytest.mark.parametrize("block,shard", [(8, 16), (32, 100)])
def test_slots_hold_the_words_that_are_taken(spark, block, shard):
    """Every block that a slot holds is cut from the source's stream by brute force, and all that is taken is in some slot."""
    g = np.random.default_rng(1)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(int(g.integers(0, 60)))), f"s{int(g.integers(0, 3))}") for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None, "s0"), (None, "n1 n2", None)], "doc_id long, text string, source string")
    how = {"block": block, "shard": shard}
    held, read, taken = (f(docs, **how).collect() for f in (mixing.mixed_blocks, mixing.mixed_text, mixing.mix))
    words = {d: (t or "").split() for d, t, _ in [*rows, (None, "n1 n2", None)]}
    slots = {}
    for r in sorted(held, key=lambda r: (r.shard, r.slot, r.place)):
        slots.setdefault((r.shard, r.slot), []).extend(words[r.doc_id][r.first_word : r.first_word + r.n_words])
    assert {k: " ".join(v) for k, v in slots.items()} == {(r.shard, r.slot): r.text for r in read}
    assert max(map(len, slots.values())) <= block
    for s in {r.shard for r in read}:
        own = sorted(r.slot for r in read if r.shard == s)
        assert own == list(range(len(own))) and len(own) <= shard
    for r in taken:
        assert r.taken == sum(h.n_words for h in held if h.doc_id == r.doc_id)
    # The blocks of a source part its words, and each is in as many slots as any other, or one more.
    for s in {r.source for r in read}:
        blocks = {}
        for r in read:
            if r.source == s:
                blocks[r.text] = blocks.get(r.text, 0) + 1
        every = sorted(w for d, t, src in [*rows, (None, "n1 n2", None)] if src == s for w in words[d])
        if set(blocks.values()) - {0}:
            assert max(blocks.values()) - min(blocks.values()) <= 1
            got = sorted(w for b in blocks for w in b.split())
            assert len(got) == len(set(got)) and set(got) <= set(every)


def test_no_blocks_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "x")], "doc_id long, text string, source string")
    assert mixing.mixed_blocks(docs).count() == 0 and mixing.mixed_text(docs).count() == 0
