import numpy as np
import pandas as pd
import pytest

from fernwave.operators import circuits, features, graph, learned, spectral
from fernwave.operators.graph import hop_matrix


def structure(seed=0, n=24):
    g = np.random.default_rng(seed)
    xyz = g.normal(0, 6, (n, 3))
    near = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) < 7
    i, j = np.nonzero(near & ~np.eye(n, dtype=bool))
    return spectral.Structure(pd.DataFrame({"node_id": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "is_active": np.arange(n) < 2}), pd.DataFrame({"i": i, "j": j}))


@pytest.mark.parametrize("metric,expected,kind", [("interference", 1, "laplacian"), ("classical", 1, "logf"), ("yukawa", 2, "laplacian"), ("gnm", 0, "laplacian"), ("coherent", 1, "logf"), ("quadrature", 0, "laplacian"), ("contrast", 0, "laplacian"), ("q_communicability", 1, "adjacency"), ("time_avg", 1, "laplacian")])
def test_row_sums(metric, expected, kind):
    s = structure()
    assert np.allclose(spectral.METRICS[metric](*s.eig(kind)).sum(1), expected)


def test_identities_of_the_laplacian():
    s = structure(3)
    w, v = s.eig()
    reach = s.hops >= 0
    parts = len({r.tobytes() for r in reach})
    assert np.isclose(w.sum(), s.degree.sum()) and np.isclose((w**2).sum(), (s.degree**2 + s.degree).sum())
    assert (w < 1e-9).sum() == parts
    assert np.isclose(-(spectral.resistance(w, v) * s.a).sum() / 2, s.n - parts)
    assert np.allclose(sum(spectral.thirds(w, v)), 1 - 1 / reach.sum(1))
    assert np.allclose(s.matrix("laplacian") @ spectral.yukawa(w, v) + 0.5 * spectral.yukawa(w, v), np.eye(s.n))
    assert np.allclose(spectral.participation(w, v).sum(1), 1)
    assert np.isclose(spectral.resonance(w, v, np.r_[1.0, 1.0, np.zeros(s.n - 2)]).sum(), 2)


def test_gauge_is_hermitian_and_its_channels_bounded():
    s = structure(1)
    h = s.matrix("gauge", 0.15)
    assert np.allclose(h, h.conj().T)
    lock, band = s.gauge_channels()
    assert (lock >= 0).all() and (lock <= 1 + 1e-9).all() and (band >= 0).all()


def test_hop_matrix_of_a_path():
    i = np.array([0, 1, 1, 2])
    j = np.array([1, 0, 2, 1])
    assert hop_matrix(i, j, 4).tolist() == [[0, 1, 2, -1], [1, 0, 1, -1], [2, 1, 0, -1], [-1, -1, -1, 0]]


def test_series_come_near_the_eigensystem():
    s = structure(2)
    f = lambda x: 1 / (x + 0.5)
    upper = 2 * s.degree.max()
    c = spectral.chebyshev(f, upper, 80)
    x = np.ones(s.n)
    t0, t1 = x, 2 / upper * (s.matrix("laplacian") @ x) - x
    y = c[0] * t0 + c[1] * t1
    for a in c[2:]:
        t0, t1 = t1, 2 * (2 / upper * (s.matrix("laplacian") @ t1) - t1) - t0
        y = y + a * t1
    assert np.allclose(y, 2, atol=1e-5)
    estimate = spectral.stochastic_pairs(s, f)
    assert np.corrcoef(estimate.ravel(), spectral.yukawa(*s.eig()).ravel())[0, 1] > 0.6  # 40 random signs for 24 nodes


def test_banks_have_their_channels():
    assert {b: len(features.channel_names(b)) for b in features.BANKS} == {"early6": 6, "bank12": 12, "bank13": 13, "bank14": 14, "bank23": 23, "bank29": 29}


def test_circuits_keep_probability_and_approach_the_exact_walk():
    s = structure(4, 10)
    fine = circuits.stepped_walk(s.a, 0, 1.0, 200)
    assert np.isclose(fine.sum(), 1) and np.abs(fine - circuits.exact_walk(s.a, 0, 1.0)).max() < 0.02
    x = np.random.default_rng(0).random((7, 3))
    assert np.allclose(np.diag(circuits.quantum_kernel(x, x)), 1)
    p = circuits.variational(x, np.zeros((0, 3)))
    assert np.allclose(p, np.sin(np.pi * x[:, 0] / 2) ** 2)
    r = circuits.reuploading(x, np.zeros((2, 2, 3)))
    assert ((r >= 0) & (r <= 1 + 1e-9)).all()


def test_learners_find_a_linear_rule():
    g = np.random.default_rng(0)
    x = g.normal(size=(200, 4))
    y = (x[:, 1] - 0.5 * x[:, 3] > 0).astype(float)
    for f in (learned.ridge_score, learned.kernel_ridge, learned.logistic):
        s = f(x[:150], y[:150], x[150:])
        pos, neg = s[y[150:] == 1], s[y[150:] == 0]
        assert (pos[:, None] > neg[None, :]).mean() > 0.9
    best = circuits.spsa(lambda t: float(((t - 1) ** 2).sum()), np.zeros(3), 300)
    assert np.abs(best - 1).max() < 0.2


def test_sparse_law_and_annealing(spark):
    g = np.random.default_rng(1)
    rows = [("s", i, int(a > 0), float(a), float(b)) for i, (a, b) in enumerate(g.normal(size=(300, 2)))]
    x = spark.createDataFrame(rows, "structure_id string, node_id long, y01 int, a double, b double")
    c = learned.sparse_law(x, ["a", "b"], 0.1)
    assert c["a"] > 0.1 and c["b"] == 0 and learned.formula(c).endswith("*a")
    pool = learned.stumps(x, ["a", "b"])
    q = learned.qubo(x, ["a", "b"], pool)
    assert q.count() == 144
    best = learned.anneal(q, 4, 500).orderBy("energy").first()
    m = np.zeros((12, 12))
    for r in q.collect():
        m[r.a, r.b] = r.q
    w = np.zeros(12)
    w[best.chosen] = 1
    assert np.isclose(w @ m @ w, best.energy) and best.energy <= 0


def test_contrast_sets_endless_times_against_heat_of_the_laplacian():
    s = structure(4)
    e, f = s.eig(), s.eig("logf", 1.0)
    assert np.allclose(spectral.metric_matrix(s, "contrast", "logf", 1.0), spectral.long_time_average(*f) - spectral.heat_average(*e))
    assert np.allclose(spectral.metric_matrix(s, "yukawa", "logf", 1.0), spectral.yukawa(*e))
    with pytest.raises(ValueError):
        spectral.metric_matrix(s, "nothing")


def test_sampled_averages_leave_out_the_start():
    s = structure(5)
    w, v = s.eig()
    times = [20 * k / 64 for k in range(1, 65)]
    assert np.allclose(spectral.time_average(w, v), np.mean([np.abs((v * np.exp(-1j * w * t)) @ v.T) ** 2 for t in times], 0))
    assert np.allclose(spectral.heat_sampled(w, v), np.mean([(v * np.exp(-w * t)) @ v.T for t in times], 0))


def test_stochastic_estimates_come_near():
    s = structure(6)
    f = lambda x: 1 / (x + 0.5)
    want = spectral.of(*s.eig(), f(s.eig()[0]))
    assert np.corrcoef(spectral.stochastic_pairs(s, f, 40, 4000).ravel(), want.ravel())[0, 1] > 0.99
    assert np.allclose(spectral.stochastic_rowsum(s, f, 80), 2.0, atol=1e-3)


def test_contact_graphs_made_in_a_structure_s_task(spark):
    """The same scores as on edges that were joined; edges do not leave the task."""
    g = np.random.default_rng(5)
    rows = [(f"s{k % 2}", 3 * k, *(float(v) for v in g.integers(0, 9, 3)), 0, False) for k in range(80)]
    nodes = spark.createDataFrame(rows, "structure_id string, node_id long, x double, y double, z double, y01 int, is_active boolean")
    f = lambda s: {"node_id": s.ids, "score": s.band(spectral.interference(*s.eig("logf", 1.0)), 2)}
    one = spectral.per_cloud(nodes, 3.0, f, "node_id long, score double")
    two = spectral.per_structure(nodes, graph.contact_edges(nodes, 3.0), f, "node_id long, score double")
    got, want = ({(r.structure_id, r.node_id): r.score for r in d.collect()} for d in (one, two))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert "Join" not in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["laplacian", "adjacency", "logf"])
def test_sampled_bands_without_the_whole_propagator(kind, monkeypatch):
    s = structure(1)
    for metric in spectral.SAMPLED:
        assert np.allclose(s.band(spectral.metric_matrix(s, metric, kind), 2), spectral.metric_band(s, metric, kind, d_min=2), atol=1e-11)
    monkeypatch.setattr(spectral, "coherent", None)  # the propagator of all pairs is not made
    spectral.metric_band(s, "contrast_sampled", kind)


def test_gauge_channels_of_both_directions_from_one_eigensystem():
    s = structure(2)
    lock, band = s.gauge_channels()
    assert len(s._eig) == 1
    both = [s.eig("gauge", b) for b in (0.15, -0.15)]
    assert np.allclose(lock, np.mean([spectral.phase_coherence(*e) for e in both], 0))
    f = lambda w: np.where(np.abs(w) > 1e-9, (1 - np.exp(-20j * w)) / np.where(np.abs(w) > 1e-9, 20j * w, 1), 1)
    assert np.allclose(band, np.mean([s.band(np.abs(spectral.of(w, v, f(w)).imag)) for w, v in both], 0))
