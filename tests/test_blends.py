"""Models of the blend against plain numpy: pooled AUC, kernel logistic regression, the blend itself."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from fernwave.operators import learned, scoring

COLS = ["x", "y", "z"]
SCHEMA = "structure_id string, node_id long, y01 int, x double, y double, z double"


def rows(seed=3, n=30):
    g = np.random.default_rng(seed)
    for s in range(4):
        for k in range(n):
            x, y, z = map(float, g.normal(0, 1, 3))
            yield str(s), 1000 * s + k, int(x * y - z + g.normal(0, 0.5) > 0), round(x, 1), y, z  # x has ties


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(rows()), SCHEMA).repartition(3)


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean()


def pct(v):
    return np.argsort(np.argsort(v, kind="stable"), kind="stable") / (len(v) - 1)


def dense_kernel_logistic(u, y, test, penalty):
    """Newton's method on all rows' own features, the root of the kernel matrix."""
    whole = np.vstack([u, test])
    w, v = np.linalg.eigh(learned.rbf(whole, whole, 1 / u.shape[1]))
    phi = np.column_stack([np.ones(len(whole)), v * np.sqrt(np.maximum(w, 0))])
    train, c, weight = phi[: len(u)], np.zeros(phi.shape[1]), np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for _ in range(20):
        p = 1 / (1 + np.exp(-train @ c))
        c -= np.linalg.solve((train * (weight * p * (1 - p))[:, None]).T @ train + penalty * np.eye(len(c)), train.T @ (weight * (p - y)) + penalty * c)
    return phi[len(u) :] @ c


def test_pooled_auc_of_other_folds(spark, table):
    long = learned.long_channels(table, COLS).withColumnRenamed("structure_id", "fold")
    got = {(r.fold, r.channel): r.auc for r in scoring.pooled_auc(long, "fold", "channel").collect()}
    p = table.toPandas()
    for s in "0123":
        rest = p[p.structure_id != s]
        for c in COLS:
            assert got[s, c] == pytest.approx(auc(rest[c].to_numpy(), rest.y01.to_numpy()), abs=1e-12)
    assert len(got) == 12


def test_pooled_auc_where_the_others_lack_a_class(spark):
    x = spark.createDataFrame([("a", "c", 1, 1.0), ("a", "c", 0, 1.0), ("b", "c", 0, 2.0)], "fold string, channel string, y01 int, score double")
    assert {r.fold: r.auc for r in scoring.pooled_auc(x, "fold", "channel").collect()} == {"a": None, "b": 0.5}
    assert scoring.pooled_auc(x.limit(0), "fold", "channel").count() == 0


def test_kernel_logistic_and_blend_against_numpy(spark, table):
    p = table.toPandas().sort_values(["structure_id", "node_id"])
    kernel = {r.node_id: r.score for r in learned.kernel_logistic_transfer(table, COLS, tolerance=1e-7).collect()}
    mixed = learned.blended(table, COLS, ["x", "y"]).toPandas().set_index(["model", "node_id"]).score
    assert mixed.index.is_unique and len(mixed) == 5 * len(p)
    won = []
    for s in "0123":
        train, test = p[p.structure_id != s], p[p.structure_id == s]
        y, ids = train.y01.to_numpy(), test.node_id.to_numpy()
        dense = dense_kernel_logistic(train[COLS].to_numpy(), y, test[COLS].to_numpy(), 1.0)
        assert np.allclose([kernel[k] for k in ids], dense, atol=1e-3)
        won.append(auc(dense, test.y01.to_numpy()))
        of = {c: auc(train[c].to_numpy(), y) for c in COLS}
        best = max(COLS, key=lambda c: max(of[c], 1 - of[c]))
        single = test[best].to_numpy() * (1 if of[best] >= 0.5 else -1)
        assert np.array_equal(mixed.loc["single"].loc[ids], single)
        parts = {m: pct(mixed.loc[m].loc[ids].to_numpy()) for m in ("logistic", "kernel", "single")}
        assert np.allclose(mixed.loc["linear"].loc[ids], (parts["logistic"] + parts["single"]) / 2)
        assert np.allclose(mixed.loc["blend"].loc[ids], sum(parts.values()) / 3)
    assert np.mean(won) > 0.75  # products of channels are out of reach of the linear model


def test_logistic_model_of_hundreds_of_channels(spark):
    """As many as kernel features may be: the score is one expression, not one nested as deep as there are channels."""
    g, cols = np.random.default_rng(2), [f"k{j}" for j in range(900)]
    v, y = np.round(g.normal(size=(12, 900)), 3), np.arange(12) // 2 % 2
    wide = spark.createDataFrame([(f"{k % 2}", k, int(y[k]), v[k].tolist()) for k in range(12)], "structure_id string, node_id long, y01 int, v array<double>")
    x = wide.select("structure_id", "node_id", "y01", *[F.col("v")[j].alias(c) for j, c in enumerate(cols)])
    got = {r.node_id: r.score for r in learned.logistic_transfer(x, cols, steps=2, damped=1.0).collect()}
    for fold in (0, 1):
        at, c = np.arange(12) % 2 != fold, np.zeros(901)
        u, t = np.column_stack([np.ones(6), v[at]]), y[at]
        weight = np.where(t > 0, (len(t) - t.sum()) / t.sum(), 1.0)
        for _ in range(2):
            p = 1 / (1 + np.exp(-np.clip(u @ c, -30, 30)))
            c -= np.linalg.solve((u * (weight * p * (1 - p))[:, None]).T @ u + np.eye(901), u.T @ (weight * (p - t)) + c)
        for k in np.flatnonzero(~at):
            assert abs(got[k] - (c[0] + v[k] @ c[1:])) < 1e-9
