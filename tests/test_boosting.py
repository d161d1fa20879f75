"""Boosted trees against a plain greedy twin, on labels that say nothing, and on odd tables."""

import numpy as np
import pandas as pd

from fernwave.operators import boosting, learned

SCHEMA = "structure_id string, node_id long, y01 int, y double, `fold` double"
COLS = ["y", "fold"]  # names that the operator gives itself


def table(spark, n=240, folds=3, rule=True, seed=1):
    g = np.random.default_rng(seed)
    v = g.normal(size=(n, 2)).round(3)
    y = (v[:, 0] * v[:, 1] > 0) if rule else g.random(n) < 0.3
    return spark.createDataFrame([(f"{i % folds}.{i % 2}", i, int(y[i]), float(v[i, 0]), float(v[i, 1])) for i in range(n)], SCHEMA).repartition(3)


def twin(p: pd.DataFrame, edges, trees, rate):
    """Each fold's model grown alone, every threshold tried on the rows themselves."""
    fold, v, y = p.structure_id.str.split(".").str[0].to_numpy(), p[COLS].to_numpy(), p.y01.to_numpy(float)
    out = np.zeros(len(p))

    def split(rows, r, w):
        best = (1e-12, None)
        for c in range(2):
            for e in edges[c]:
                low = v[rows, c] <= e
                a, b = w[rows][low], w[rows][~low]
                if len(a) and len(b):
                    gain = a.sum() * b.sum() / (a.sum() + b.sum()) * ((a @ r[rows][low]) / a.sum() - (b @ r[rows][~low]) / b.sum()) ** 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (c, e))
        return best[1]

    for f in np.unique(fold):
        train = np.flatnonzero(fold != f)
        w = np.where(y > 0.5, (1 - y[train]).sum() / y[train].sum(), 1.0)
        score = np.full(len(p), (w[train] @ y[train]) / w[train].sum())
        for _ in range(trees):
            r = y - score
            leaf, root = np.zeros(len(p), int), split(train, r, w)
            if root:
                leaf += 2 * (v[:, root[0]] > root[1])
            for side in (0, 2):
                some = leaf // 2 * 2 == side
                kid = split(train[some[train]], r, w)
                if kid:
                    leaf += some * (v[:, kid[0]] > kid[1])
            for one in np.unique(leaf[train]):
                rows = train[leaf[train] == one]
                score[leaf == one] += rate * (w[rows] @ r[rows]) / w[rows].sum()
        out[fold == f] = score[fold == f]
    return out


def test_like_models_grown_alone(spark, monkeypatch):
    monkeypatch.setattr(boosting, "HELD", 3)  # several checkpoints of the scores
    monkeypatch.setattr(boosting, "ROWS", 100)
    x = table(spark)
    got, forest = boosting.boosted(x, COLS, boosting.Settings(trees=8, rate=0.3, share=1.0))
    p = got.toPandas().merge(x.toPandas()[["node_id", *COLS]], on="node_id")
    assert np.allclose(p.score, twin(p, forest.edges, 8, 0.3), atol=1e-9)
    again = boosting.boosted(x.repartition(5), COLS, boosting.Settings(trees=8, rate=0.3, share=1.0))[1]
    assert (again.channel == forest.channel).all() and (again.cut == forest.cut).all() and np.allclose(again.value, forest.value)
    shares = forest.importance(spark).groupBy("fold").sum("importance").collect()
    assert len(shares) == 3 and all(abs(r[1] - 1) < 1e-9 for r in shares)


def auc(p):
    rank, n1 = p.score.rank(), p.y01.sum()
    return (rank[p.y01 == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(p) - n1))


def test_finds_an_interaction_and_nothing_in_random_labels(spark):
    s = boosting.Settings(trees=30, rate=0.2)
    assert auc(boosting.boosted(table(spark, 900), COLS, s)[0].toPandas()) > 0.95
    assert 0.35 < auc(boosting.boosted(table(spark, 900, rule=False), COLS, s)[0].toPandas()) < 0.65


def test_channels_allowed_and_lean(spark):
    _, forest = boosting.boosted(table(spark), COLS, boosting.Settings(trees=3), {"0": ["y"], "1": ["fold"], "2": []})
    used = {(r.fold, r.channel) for r in forest.splits(spark).collect()}
    assert used == {("0", "y"), ("1", "fold")}
    auc_rows = spark.createDataFrame([(f, c, a) for f, pairs in {"0": (0.9, 0.5), "1": (0.5, 0.2), "2": (0.5, 0.6)}.items() for c, a in zip("ab", pairs)], "structure_id string, channel string, auc double")
    got = {r.fold: r.channels for r in learned.lean_folds(auc_rows.withColumnRenamed("structure_id", "fold"), 1).collect()}
    assert got == {"0": ["b"], "1": ["a"], "2": ["a"]}  # without fold 0, b tells more


def test_odd_tables(spark):
    s = boosting.Settings(trees=2)
    assert boosting.boosted(table(spark).limit(0), COLS, s)[0].count() == 0
    one = boosting.boosted(table(spark, 20, folds=1), COLS, s)[0].toPandas()  # nothing to learn from
    assert len(one) == 20 and (one.score == 0).all()
    rows = [("0", 1, 1, None, float("nan")), ("0", 1, 1, None, float("nan")), ("1", 2, None, None, float("nan")), ("1", None, 0, None, 1.0), ("2", 4, 1, None, 2.0)]
    odd = boosting.boosted(spark.createDataFrame(rows, SCHEMA), COLS, s)[0].toPandas()
    assert len(odd) == 5 and odd.score.notna().all()
