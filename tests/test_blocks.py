"""Blocks of vectors, low modes, clusters and models that are sums over tasks, against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwave.operators import blocks, clusters, graph, learned, scoring

NODES = "structure_id string, node_id long, x double, y double, z double"


def ring(spark, n, structure="r"):
    nodes = spark.createDataFrame([(structure, 3 * k, float(k), 0.0, 0.0) for k in range(n)], NODES)
    edges = spark.createDataFrame([(structure, 3 * k, 3 * ((k + s) % n)) for k in range(n) for s in (1, -1)], "structure_id string, i long, j long")
    return nodes, edges


def laplacian(edges, n):
    m = np.zeros((n, n))
    for r in edges.collect():
        m[r.i // 3, r.j // 3] = -1
    return np.diag(-m.sum(1)) + m


def test_series_of_blocks(spark):
    """Every vector of a block under f(L), against the eigensystem."""
    nodes, edges = ring(spark, 20)
    x = blocks.signs(nodes, 4, 2)
    f = lambda v: np.exp(-v)
    got = blocks.series(nodes, edges, x, 2, f, 24, ("block",)).collect()
    w, v = np.linalg.eigh(laplacian(edges, 20))
    m = v @ np.diag(f(w)) @ v.T
    for b in (0, 1):
        rows = sorted((r for r in got if r.block == b), key=lambda r: r.node_id)
        for j in (0, 1):
            assert np.allclose(m @ [r[f"x{j}"] for r in rows], [r[f"y{j}"] for r in rows], atol=1e-8)
    assert {abs(r.x0) for r in got} == {1.0}


def test_low_modes_of_a_ring_and_parts(spark):
    nodes, edges = ring(spark, 12)
    w, x = blocks.low_modes(nodes, edges, k=4)
    dense, lap = np.linalg.eigvalsh(laplacian(edges, 12)), laplacian(edges, 12)
    assert np.allclose(sorted(r.w for r in w.collect()), dense[:4], atol=1e-9)
    v = np.array([[r[f"x{j}"] for j in range(4)] for r in x.orderBy("node_id").collect()])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8) and np.allclose(lap @ v, v * dense[:4], atol=1e-6)
    other = spark.createDataFrame([("r", 1000, 0.0, 0.0, 0.0)], NODES)
    parts = {r.node_id: r.part for r in blocks.parts(nodes.unionByName(other), edges).collect()}
    assert set(parts[3 * k] for k in range(12)) == {0} and parts[1000] == 1000


def test_spectral_clusters_of_cliques(spark):
    """Three cliques without links between them: clusters are the cliques, whatever the chunks."""
    nodes = spark.createDataFrame([("s", k, 0.0, 0.0, 0.0) for k in range(18)], NODES)
    edges = spark.createDataFrame([("s", a, b) for a in range(18) for b in range(18) if a != b and a % 3 == b % 3], "structure_id string, i long, j long")
    c = clusters.spectral_clusters(nodes, edges, 3)
    assert {r.node_id: r.cluster_id for r in c.collect()} == {k: k % 3 for k in range(18)}
    assert sorted(map(tuple, clusters.rolled(edges, c).drop("structure_id").collect())) == [(k, 6, k, 30, 0) for k in range(3)]


def test_kmeans_over_chunks(spark):
    g = np.random.default_rng(0)
    centre = g.uniform(-100, 100, (5, 3))
    rows = [(s, k, (centre[k % 5] + g.normal(0, 0.5, 3)).tolist()) for s in ("a", "b") for k in range(200)]
    points = spark.createDataFrame(rows, "structure_id string, node_id long, v array<double>")
    for chunk in (30, 4096):
        got = clusters.kmeans(points, 5, chunk=chunk).collect()
        assert {(r.structure_id, r.node_id, r.cluster_id) for r in got} == {(s, k, k % 5) for s, k, _ in rows}
    few = spark.createDataFrame([("a", k, [1.0, 1.0]) for k in range(4)], "structure_id string, node_id long, v array<double>")
    assert {r.cluster_id for r in clusters.kmeans(few, 3).collect()} == {0}  # all at one place


def table(spark, n=40):
    g = np.random.default_rng(1)
    rows = [(str(s), k, int(g.random() < 0.4), *map(float, g.normal(0, 1, 3))) for s in range(4) for k in range(n)]
    return spark.createDataFrame(rows, "structure_id string, node_id long, y01 int, x double, y double, z double").repartition(3)


def folds(x):
    pdf, cols = x.toPandas(), ["x", "y", "z"]
    for s in "0123":
        a, b = pdf[pdf.structure_id != s], pdf[pdf.structure_id == s]
        yield s, a[cols].to_numpy(), a.y01.to_numpy(float), b[cols].to_numpy(), b.node_id.to_numpy()


def test_logistic_models_have_no_slope_left(spark):
    x = table(spark)
    fits = {r.fold: np.array(r.c) for r in learned.logistic_fits(x, ["x", "y", "z"]).collect()}
    scores = {(r.structure_id, r.node_id): r.score for r in learned.logistic_transfer(x, ["x", "y", "z"]).collect()}
    for s, u, y, test, ids in folds(x):
        c, u = fits[s], np.column_stack([np.ones(len(u)), u])
        w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
        assert abs(u.T @ (w * (1 / (1 + np.exp(-u @ c)) - y)) + learned.DAMPED * c).max() < 1e-8
        assert np.allclose([scores[s, k] for k in ids], np.column_stack([np.ones(len(test)), test]) @ c)


def test_kernel_models_by_landmarks(spark, monkeypatch):
    """With a small tolerance the landmarks give the dense answer; rows that the sample missed are found and added."""
    x = table(spark)
    dense = {(s, k): v for s, u, y, test, ids in folds(x) for k, v in zip(ids, learned.kernel_ridge(u, y, test), strict=True)}
    for sought, added in ((2000, 200), (10, 20)):
        monkeypatch.setattr(learned, "SOUGHT", sought)
        monkeypatch.setattr(learned, "ADDED", added)
        got = {(r.structure_id, r.node_id): r.score for r in learned.kernel_ridge_transfer(x, ["x", "y", "z"], tolerance=1e-7).collect()}
        assert set(got) == set(dense) and max(abs(got[k] - dense[k]) for k in dense) < 1e-4
    monkeypatch.setattr(learned, "LANDMARKS", 5)
    with pytest.raises(ValueError):
        learned.kernel_features(x, ["x", "y", "z"], 1e-7)


@pytest.mark.parametrize("parts", [1, 7])
def test_bootstrap_against_plain_resampling(spark, parts):
    """Intervals from sums of ranges equal those of whole vectors: a score that most rows share, several structures, one class."""
    g = np.random.default_rng(2)
    rows = [(s, 1000 * n + k, float(0 if g.random() < 0.6 else g.integers(0, 9)), int(g.random() < 0.5)) for n, s in enumerate(("a", "b")) for k in range(300)]
    rows += [("one", 5000 + k, float(k), 1) for k in range(5)] + [("flat", 6000 + k, 1.0, k % 2) for k in range(40)]
    x = spark.createDataFrame(rows, "structure_id string, node_id long, score double, y01 int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r.structure_id: (r.ci_low, r.ci_high) for r in scoring.bootstrap_auc(x, 200).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    named = x.withColumn("h", F.md5(F.concat_ws(":", F.col("node_id").cast("string"), F.lit("0")))).toPandas()
    for s, p in named.groupby("structure_id"):
        a, b = (np.array([int(h[i : i + 8], 16) for h in p.h]) for i in (0, 8))
        w, y, v = scoring.weights(a, b, 200), p.y01.to_numpy() > 0, p.score.to_numpy()
        won = (v[y][:, None] > v[~y]) + 0.5 * (v[y][:, None] == v[~y])
        pairs = w[y].sum(0) * w[~y].sum(0)
        auc = np.einsum("ir,ij,jr->r", w[y], won, w[~y])[pairs > 0] / pairs[pairs > 0]
        assert np.allclose(got[s], np.quantile(auc, [0.025, 0.975])) if len(auc) else got[s] == (None, None)
    assert set(got) == {"a", "b", "one", "flat"} and got["flat"] == (0.5, 0.5)
    w = scoring.weights(np.arange(3000) * 7919, np.arange(3000) * 104729, 100)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
