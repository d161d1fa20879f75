import random
import re

import pytest

from fernwave.llm import simjoin


def shingles(text, size=5):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", low)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows):
    """class_id, n_links and n_copies by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(sets[d], d)
    reps = [(s, d) for s, d in rep.items() if s]
    links, root = {d: 0 for _, d in reps}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(reps):
        for b, y in reps[i + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b):
                links[x] += 1
                links[y] += 1
                p, q = sorted((find(x), find(y)))
                root[q] = p
    out = []
    for d, _ in rows:
        s = sets[d]
        out.append((d, find(rep[s]), links[rep[s]], sum(sets[e] == s for e, _ in rows)) if s else (d, d, 0, 1))
    return sorted(out)


def corpus(seed):
    g = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [g.choice(vocab) for _ in range(g.randint(60, 200))]
        for _ in range(g.choice([1, 2, 5, 40])):
            t = list(base)
            for _ in range(g.randint(0, 4)):
                t[g.randrange(len(t))] = g.choice(vocab)
            rows.append((n, " ".join(t)))
            n += 1
    short = [None, "", "...", "One", "one!", "a b c d", "A b c d", "a b c d e", "ü b c d e", "long " * 20000]
    return rows + [(n + i, t) for i, t in enumerate(short)]


@pytest.mark.parametrize("block", [128, 16, 4])
def test_classes_and_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    rows = corpus(block)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, set_key string, tree int")
    got = sorted(tuple(r) for r in simjoin.similarity_classes(docs).collect())
    assert got == brute(rows)


def test_a_large_family_is_joined_level_by_level(spark, monkeypatch):
    """Documents that drift apart step by step, in a family of many blocks, over several set sizes."""
    monkeypatch.setattr(simjoin, "BLOCK", 8)
    g = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(g.randint(0, 6)):
            t[g.randrange(len(t))] = f"n{g.randrange(10**6)}"
        rows.append((i, " ".join(t[: g.randint(100, 150)])))
    got = sorted(tuple(r) for r in simjoin.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simjoin.similarity_classes(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, simjoin.similarity_classes(same).collect()), key=str)
    assert got == [(1, 1, 0, 3), (1, 1, 0, 3), (2, 1, 0, 3), (None, None, 0, 1)]


def test_prefix_is_long_as_recall_allows():
    d = simjoin.longest_prefix(0.8)
    assert simjoin.chance(0.8, d) >= simjoin.RECALL > simjoin.chance(0.8, d + 1)


def levels(spark, rows, shortest=1):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = simjoin.neighbours(simjoin.forest(simjoin.sketch(docs)), shortest).collect()
    out = {}
    for r in near:
        pair = tuple(sorted((r.u, r.v)))
        out[pair] = max(out.get(pair, 0), r.level)
    return out


def test_neighbours_have_the_longest_prefix_of_any_tree(spark):
    rows = [(d, t) for d, t in corpus(3) if d < 60]
    got = levels(spark, rows)
    import numpy as np
    import pyarrow as pa

    from fernwave.llm.shingles import shingle_sets

    want = {}
    ids = np.array([d for d, _ in rows])
    (_, _, sets, count), = shingle_sets(pa.array([t for _, t in rows]))
    sig = simjoin.signatures(sets, count)
    for t in range(simjoin.TREES):
        order = sorted(range(len(rows)), key=lambda i: (sig[i, t].tolist(), ids[i]))
        for a, b in zip(order, order[1:]):
            level = int(np.cumprod(sig[a, t] == sig[b, t]).sum())
            if level:
                pair = tuple(sorted((int(ids[a]), int(ids[b]))))
                want[pair] = max(want.get(pair, 0), level)
    assert got == want


def test_prefixes_are_shortened_only_as_far_as_the_pairs_ask_for(spark, monkeypatch):
    asked = []
    joined = simjoin.joined_families
    monkeypatch.setattr(simjoin, "joined_families", lambda f, links, tasks: asked.append(1) or joined(f, links, tasks))
    words = [f"w{i}" for i in range(400)]
    alike = [(i, " ".join([*words, f"end{i}"])) for i in range(6)]
    assert {r.class_id for r in simjoin.similarity_classes(spark.createDataFrame(alike, "doc_id long, text string")).collect()} == {0}
    assert len(asked) == 1  # all pairs are so alike that the longest prefix finds them
    asked.clear()
    far = alike + [(10, " ".join([*words[:360], *[f"x{i}" for i in range(36)]]))]
    got = {r.doc_id: r.n_links for r in simjoin.similarity_classes(spark.createDataFrame(far, "doc_id long, text string")).collect()}
    assert len(asked) > 1 and got[10] == 6 and got[0] == 6
