"""Queries that once lost partners or folds where a label's ids reach beyond ten thousand, against their SQL and plain numpy."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from fernwave.operators import blocks, circuits, graph, paths, spectral
from fernwave.plans import spectra

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The points of the smallest table, those of every other id in a second block of ids."""
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    path = tmp_path_factory.mktemp("whole")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (vec_id + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 10000 END AS vec_id) FROM '{DATA}/embeddings.parquet') TO '{path}/embeddings.parquet'")
    return str(path)


def both(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{path}/embeddings.parquet'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, path).toPandas()
    cols = sorted(want.columns)
    key = [c for c in cols if want[c].dtype.kind != "f"]
    a, b = (d[cols].sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert np.allclose(a[c], b[c], atol=1e-5) if a[c].dtype.kind == "f" else a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
    return got


@pytest.mark.parametrize("name", ["logistic_fit", "best_channel_pooled"])
def test_every_structure_is_a_fold(spark, grown, name):
    got = both(spark, grown, name)
    assert got["structure_id" if name == "logistic_fit" else "fold"].nunique() == 20


# Structures of a label's points, whatever their ids


@pytest.mark.parametrize("name", ["knn_edges", "graph_distance_hist", "graph_centrality", "band_score_shared", "active_raw", "active_zscore", "active_zabs", "cheb_rowsum", "ctqw_probs", "sink_matrix"])
def test_partners_are_sought_in_the_whole_label(spark, grown, name):
    got = both(spark, grown, name)
    if "structure_id" in got:
        assert set(got["structure_id"]) == {str(k) for k in range(10)}
    if name == "knn_edges":
        assert ((got.i < 10_000) != (got.j < 10_000)).any()


def test_nearest_rows_by_blocks_are_those_of_all_pairs(monkeypatch):
    g = np.random.default_rng(1)
    for x in (g.normal(size=(1500, 3)), np.round(g.normal(size=(1500, 3))), np.zeros((1500, 3)), np.column_stack([np.arange(1500.0), np.zeros(1500), np.zeros(1500)])):
        ids = np.arange(1500) // 2 if len(np.unique(x[:, 0])) == 1 else np.arange(1500)
        for k in (1, 10):
            few = graph.nearest_rows(ids, x, k)
            with monkeypatch.context() as m:
                m.setattr(graph, "CHUNK", 1500)
                all_ = graph.nearest_rows(ids, x, k)
            assert all(np.array_equal(p, q) for p, q in zip(few, all_, strict=True))


def test_searches_in_tasks_by_joins_and_by_chunks_agree(spark, monkeypatch):
    """Two parts, one of them without an active node, and a node alone; sources in several chunks."""
    monkeypatch.setattr(graph, "SOURCES", 64)
    g = np.random.default_rng(4)
    rows = [("a", k) for k in range(150)] + [("b", k) for k in range(40)] + [("c", k) for k in range(9)]
    pairs = {(s, *sorted((int(p), int(q)))) for s, n, m in (("a", 149, 220), ("b", 40, 60)) for p, q in g.integers(0, n, (m, 2)) if p != q} | {("c", k, k + 1) for k in range(8) if k != 5}
    nodes = spark.createDataFrame([(s, k, k % 50 == 3 if s != "c" else k in (0, 8)) for s, k in rows], "structure_id string, node_id long, is_active boolean")
    edges = spark.createDataFrame([(s, i, j) for s, p, q in pairs for i, j in ((p, q), (q, p))], "structure_id string, i long, j long")
    seen = lambda df: sorted(map(tuple, df.collect()))
    for f in (graph.distance_histogram, graph.reach_centrality, graph.active_shells):
        assert seen(f(nodes, edges)) == seen(f(nodes, edges, most=50))
    far = graph.graph_distance(nodes, edges)
    assert seen(graph.distance_histogram(nodes, edges)) == seen(far.groupBy("structure_id", "d").count().selectExpr("structure_id", "d", "count"))
    of_active = far.join(nodes.filter("is_active").selectExpr("structure_id", "node_id AS j"), ["structure_id", "j"]).groupBy("structure_id", "i").agg({"d": "min", "j": "count"}).toPandas()
    n_active = {r.structure_id: r["count"] for r in nodes.filter("is_active").groupBy("structure_id").count().collect()}
    want = sorted((r.structure_id, r.i, r["min(d)"]) for _, r in of_active.iterrows() if r["count(j)"] == n_active[r.structure_id])
    assert seen(graph.active_shells(nodes, edges)) == want


def test_sparse_walk_is_the_dense_one():
    g = np.random.default_rng(7)
    a = np.triu(g.random((40, 40)) < 0.1, 1).astype(float)
    a += a.T
    i, j = np.nonzero(a)
    assert np.abs(circuits.sparse_walk(i, j, 40, 3, 2.0) - circuits.exact_walk(a, 3, 2.0)).max() < 1e-11


# Long paths


def path_of(n):
    r = np.arange(n - 1)
    g = np.random.default_rng(n)
    at = pd.DataFrame({"node_id": 3 * np.arange(n), "x": g.normal(0, 10, n), "y": g.normal(0, 10, n)})
    return spectral.Structure(at, pd.DataFrame({"i": 3 * np.append(r, r + 1), "j": 3 * np.append(r + 1, r)}))


@pytest.mark.parametrize("n", [2, 3, 7, 120, 121])
def test_long_paths_are_as_dense_ones(monkeypatch, n):
    for metric in spectra.MATRICES:
        kind, params = spectra.KINDS.get(metric, "laplacian"), spectra.PARAMS.get(metric, {})
        dense = spectral.metric_band(path_of(n), metric, kind, **params)
        with monkeypatch.context() as m:
            m.setattr(spectral, "DENSE", 1)
            m.setattr(np.linalg, "eigh", None)  # not used
            known = spectral.metric_band(path_of(n), metric, kind, **params)
        assert np.abs(dense - known).max() < 1e-8 * max(1.0, np.abs(dense).max()), metric
    dense = path_of(n).gauge_channels()
    monkeypatch.setattr(spectral, "DENSE", 1)
    monkeypatch.setattr(paths, "ENTRIES", 500)
    for a, b in zip(dense, path_of(n).gauge_channels(), strict=True):
        assert np.abs(a - b).max() < 1e-8


def test_only_paths_are_taken_for_paths():
    ring = path_of(5)
    assert ring.is_path
    ids = ring.ids
    assert not spectral.Structure(ring.nodes, pd.DataFrame({"i": [*ids[:-1], *ids[1:], ids[0], ids[-1]], "j": [*ids[1:], *ids[:-1], ids[-1], ids[0]]})).is_path


@pytest.mark.parametrize("name", ["path_time_avg_sampled", "path_gauge"])
def test_paths_hold_the_whole_label(spark, grown, name):
    both(spark, grown, name)


def test_probes_and_terms_are_the_reference_projects(spark):
    """6 sqrt(n) probes, 40 to 400, in tasks as by joins; 40 terms of the series."""
    g, n = np.random.default_rng(6), 60
    pairs = {tuple(sorted(map(int, p))) for p in g.integers(0, n, (110, 2)) if p[0] != p[1]}
    nodes = spark.createDataFrame([("a", k) for k in range(n)], "structure_id string, node_id long")
    edges = spark.createDataFrame([("a", i, j) for p, q in pairs for i, j in ((p, q), (q, p))], "structure_id string, i long, j long")
    assert [r.probes for r in blocks.probe_counts(nodes).collect()] == [46]
    assert blocks.signs(nodes, blocks.probe_counts(nodes), 20).filter("block = 2 AND x5 <> 0 AND x6 = 0").count() == n
    f = lambda x: 1 / (x + 0.5)
    s = spectral.Structure(nodes.toPandas(), edges.toPandas())
    want = s.band(spectral.stochastic_pairs(s, f, 5, 46))
    for dense in (None, 10):
        got = blocks.stochastic_band(nodes, edges, f, 5, dense=dense).orderBy("node_id").toPandas()
        assert np.abs(got.score.to_numpy() - want).max() < 1e-9
    assert "range(40) a(k)" in entry.oracle_sql()["stochastic_connectivity"]


def test_smoothing_over_contacts_moves_none_of_them(spark):
    """As over their edges, in one shuffle of few rows for each node where there are hundreds of contacts."""
    g = np.random.default_rng(8)
    rows = [(s, k, *map(float, g.normal(0, w, 3)), float(g.normal())) for s, n, w in (("a", 300, 2.0), ("b", 40, 30.0)) for k in range(n)]
    nodes = spark.createDataFrame(rows, "structure_id string, node_id long, x double, y double, z double, score double")
    scores = nodes.select("structure_id", "node_id", "score")
    got = graph.smooth(scores, nodes, None, 2, 0.3, cutoff=8.0).toPandas().set_index(["structure_id", "node_id"]).score
    want = graph.smooth(scores, nodes, graph.contact_edges(nodes, 8.0), 2, 0.3).toPandas().set_index(["structure_id", "node_id"]).score
    assert len(got) == len(rows) and np.abs(got - want.loc[got.index]).max() < 1e-12
    # Contacts are summed where they are made: the plan deals cells, and sums by node, but never the pairs.
    plan = graph.smooth(scores, nodes, None, 1, cutoff=8.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [structure_id#" in plan and "partial_avg" in plan
