import random

import numpy as np
import pytest

from fernwave.llm import components as c


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


GRAPHS = {
    "path": [(i, i + 1) for i in range(300)],
    "shuffled path": [((i * 37) % 301, ((i + 1) * 37) % 301) for i in range(300)],
    "star": [(0, i) for i in range(1, 200)],
    "late hub": [(1000, i) for i in range(1, 200)],
    "mixed": [(random.Random(1).randrange(400) + i % 3 * 400, random.Random(i).randrange(200) + i % 3 * 400) for i in range(700)],
    "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_roots_match_brute_force(spark, name):
    edges = GRAPHS[name]
    d = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.node: r.root for r in c.components(d).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want and c.components(d).count() == len(want)


def test_contraction_of_a_long_chain():
    u = np.arange(5000)[::-1].copy()
    node, root = c.contracted(u + 1, u)
    assert sorted(node.tolist()) == list(range(1, 5001)) and set(root.tolist()) == {0}
