"""Matrix functions of graph Hamiltonians, one structure a task: a dense eigensystem feeds everything asked of it.

`METRICS` maps names to functions of an eigensystem (w ascending, V) that give the N x N matrix of a metric.
`register_metric` adds to them. Rows come back per node or per pair, so that only what a query needs leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import S, contact_rows, hop_matrix

TINY = 1e-9


def of(w: np.ndarray, v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """V f(w) V*."""
    return (v * f) @ v.conj().T


def positive_inverse(w: np.ndarray) -> np.ndarray:
    return np.where(w > TINY, 1 / np.where(w > TINY, w, 1), 0.0)


def sinc(x: np.ndarray) -> np.ndarray:
    return np.sinc(x / np.pi)


def typical_time(w: np.ndarray) -> float:
    """Inverse of the median gap between eigenvalues."""
    return 1.0 / max(abs(float(np.median(np.diff(np.sort(w))))) if len(w) > 1 else 1.0, 1e-6)


def coherent(w, v, t=None):
    return np.abs(of(w, v, np.exp(-1j * w * (typical_time(w) if t is None else t)))) ** 2


def time_average(w, v, t=20.0, steps=64):
    """Mean over `steps` sampled times up to t of the squared propagator; the start itself is not among them."""
    return sum(coherent(w, v, x) for x in np.linspace(t / steps, t, steps)) / steps


def long_time_average(w, v):
    """The same for endless times, when no eigenvalue occurs twice."""
    return (v**2) @ (v**2).T


def heat_average(w, v, t=20.0):
    x = w * t
    return of(w, v, np.where(np.abs(x) > TINY, -np.expm1(-x) / np.where(np.abs(x) > TINY, x, 1), 1.0))


def heat_sampled(w, v, t=20.0, steps=64):
    return of(w, v, np.exp(-np.outer(np.linspace(t / steps, t, steps), w)).mean(0))


def interference(w, v, t=20.0):
    return of(w, v, sinc(w * t))


def quadrature(w, v, t=20.0):
    x = w * t
    return of(w, v, np.where(np.abs(x) > TINY, (1 - np.cos(x)) / np.where(np.abs(x) > TINY, x, 1), 0.0))


def pseudo_inverse(w, v):
    return of(w, v, positive_inverse(w))


def resistance(w, v):
    g = pseudo_inverse(w, v)
    d = np.diag(g)
    return -(d[:, None] + d[None, :] - 2 * g)


def yukawa(w, v, m2=0.5):
    return of(w, v, 1 / (w + m2))


def communicability(w, v, beta=0.15):
    return of(w, v, np.exp(beta * w))


def q_communicability(w, v, beta=0.5):
    return np.abs(of(w, v, np.exp(1j * beta * w))) ** 2


def contrast(w, v, t=20.0):
    """What the walk keeps for endless times beyond what heat does."""
    return long_time_average(w, v) - heat_average(w, v, t)


def contrast_sampled(w, v, t=20.0, steps=64):
    return time_average(w, v, t, steps) - heat_sampled(w, v, t, steps)


def dephased(w, v, p=0.0, t=20.0):
    """Between interference (p = 0) and heat (p = 1)."""
    return (1 - p) * interference(w, v, t) + p * heat_average(w, v, t)


#: Time averages are taken in closed form; the sampled ones bear names of their own.
METRICS: dict[str, Callable] = {
    "time_avg": long_time_average, "time_avg_sampled": time_average, "ita": long_time_average, "interference": interference, "quadrature": quadrature, "coherent": coherent, "classical": heat_average, "classical_sampled": heat_sampled,
    "contrast": contrast, "contrast_sampled": contrast_sampled, "gnm": pseudo_inverse, "resistance": resistance, "yukawa": yukawa, "communicability": communicability, "q_communicability": q_communicability, "dephased": dephased,
}


#: Paths of more nodes than this have no eigensystem made: their modes are known.
DENSE = 3000

#: Metrics that belong to the Laplacian, whatever Hamiltonian the others act on.
OF_LAPLACIAN = ("classical", "classical_sampled", "gnm", "resistance", "yukawa")


def metric_matrix(s: Structure, metric: str, kind: str = "laplacian", value: float | None = None, **params) -> np.ndarray:
    """The N x N matrix of a named metric of a structure; an unknown name is an error.

    The contrast sets the walk of the chosen Hamiltonian against the heat of the Laplacian.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric in OF_LAPLACIAN:
        return METRICS[metric](*s.eig(), **params)
    if metric == "contrast":
        return long_time_average(*s.eig(kind, value)) - heat_average(*s.eig(), **params)
    if metric == "contrast_sampled":
        return time_average(*s.eig(kind, value), **params) - heat_sampled(*s.eig(), **params)
    return METRICS[metric](*s.eig(kind, value), **params)


#: Metrics that hold the sampled time average of the walk, by the heat that is taken from it.
SAMPLED = {"time_avg_sampled": None, "contrast_sampled": heat_sampled}
#: Pairs of nodes whose amplitudes are made at once.
PAIRS = 4096


def sampled_band(s: Structure, kind: str = "laplacian", value: float | None = None, d_min: int = 3, t: float = 20.0, steps: int = 64) -> np.ndarray:
    """Row sums of `time_average` over pairs of d_min hops and more: a walk keeps its probability, so they are one less the
    pairs nearer than that, and only these few pairs' amplitudes are made."""
    w, v = s.eig(kind, value)
    wave = np.exp(-1j * np.outer(w, np.linspace(t / steps, t, steps)))
    i, j = np.nonzero((s.hops >= 0) & (s.hops < max(1, d_min)))
    near = np.zeros(s.n)
    for lo in range(0, len(i), PAIRS):
        a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        both = v[a] * v[b].conj()
        u = np.abs(both @ wave) ** 2 if np.iscomplexobj(both) else (both @ wave.real) ** 2 + (both @ wave.imag) ** 2
        near += np.bincount(a, u.mean(1), s.n)
    return 1.0 - near


def metric_band(s: Structure, metric: str, kind: str = "laplacian", value: float | None = None, d_min: int = 3, d_max: int | None = None, **params) -> np.ndarray:
    """Row sums of a named metric over pairs from d_min (to d_max) hops apart; those of long paths in closed form."""
    if s.n > DENSE and d_max is None and value is None and kind in ("laplacian", "adjacency") and metric in METRICS and s.is_path:
        from . import paths

        return paths.band(s.n, metric, kind, max(1, d_min), **params)
    if metric not in SAMPLED or d_max is not None:
        return s.band(metric_matrix(s, metric, kind, value, **params), d_min, d_max)
    heat = SAMPLED[metric]
    walk = sampled_band(s, kind, value, d_min, **params)
    return walk if heat is None else walk - s.band(heat(*s.eig(), **params), d_min)


def register_metric(name: str, function: Callable) -> None:
    METRICS[name] = function


# Per-node channels


def effective_mass(w, v, t=20.0):
    return -np.log(np.clip(((v**2) * np.exp(-w * t)).sum(1), 1e-12, None)) / t


def heat_kernel(w, v, t=20.0):
    return ((v**2) * np.exp(-w * t)).sum(1)


def commute(w, v):
    return ((v**2) * positive_inverse(w)).sum(1)


def phase_coherence(w, v, t=None):
    u = of(w, v.astype(complex), np.exp(-1j * w * (typical_time(w) if t is None else t)))
    return np.abs(u.sum(1)) / (np.abs(u).sum(1) + 1e-12)


def sample_times(w, t_max=None, oversample=2.0):
    if t_max is None:
        some = w[w > TINY]
        t_max = min(4 * np.pi / some.min(), 200.0) if len(some) else 40.0
    n = int(min(2000, max(64, np.ceil(t_max * oversample * (w.max() + TINY) / np.pi))))
    return np.linspace(0, t_max, n)


def resonance(w, v, reference, t_max=None):
    """Mean over time of what starts on the reference nodes and is found on each node."""
    c = v.T @ reference
    psi = (np.exp(-1j * np.outer(sample_times(w, t_max), w)) * c) @ v.T
    return (np.abs(psi) ** 2).mean(0)


def phase_locking(w, v, reference, t_max=40.0):
    psi = (np.exp(-1j * np.outer(sample_times(w, t_max), w)) * (v.T @ reference)) @ v.T
    return np.abs((psi / (np.abs(psi) + 1e-12)).mean(0))


def thirds(w, v):
    """Squared components of the lowest fifth, the next two and the last two fifths of the non-zero modes."""
    i = np.flatnonzero(w > TINY)
    k = len(i) // 5
    parts = (i[: max(1, k)], i[k : 3 * len(i) // 5], i[3 * len(i) // 5 :])
    return [(v[:, p] ** 2).sum(1) for p in parts]


def participation(w, v, bins=20):
    """(N, bins): squared components by eigenvalue bin; rows sum to 1."""
    x = (w - w.min()) / (w.max() - w.min() + 1e-12)
    b = np.minimum((x * bins).astype(int), bins - 1)
    return np.stack([(v[:, b == k] ** 2).sum(1) for k in range(bins)], 1)


class Structure:
    """One structure inside a task: ids, adjacency, coordinates; matrices, hop counts and eigensystems are made when asked for."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        nodes = nodes.sort_values("node_id", kind="stable")
        self.nodes, self.ids = nodes, nodes["node_id"].to_numpy()
        self.n = len(self.ids)
        self.i, self.j = np.searchsorted(self.ids, edges["i"]), np.searchsorted(self.ids, edges["j"])
        self.degree = np.bincount(np.unique(self.i * self.n + self.j) // max(1, self.n), minlength=self.n).astype(float)
        self._eig: dict = {}
        self._a = self._hops = None

    @property
    def a(self) -> np.ndarray:
        if self._a is None:
            self._a = np.zeros((self.n, self.n))
            self._a[self.i, self.j] = 1.0
        return self._a

    @property
    def is_path(self) -> bool:
        """Whether the nodes, by id, are each in contact with the next, and with no other."""
        return len(np.unique(self.i * self.n + self.j)) == 2 * (self.n - 1) and bool((np.abs(self.i - self.j) == 1).all())

    @property
    def hops(self) -> np.ndarray:
        if self._hops is None:
            self._hops = hop_matrix(self.i, self.j, self.n)
        return self._hops

    def weights(self, sigma: float) -> np.ndarray:
        f = np.log(self.degree + 1)
        return self.a * np.exp(-((f[:, None] - f[None, :]) ** 2) / (2 * sigma**2))

    def matrix(self, kind: str, value: float | None = None) -> np.ndarray:
        if kind == "adjacency":
            return self.a
        if kind == "gauge":
            x, y = self.nodes["x"].to_numpy(), self.nodes["y"].to_numpy()
            return np.diag(self.degree) - self.a * np.exp(1j * value * (np.outer(x, y) - np.outer(y, x)))
        w = self.weights(1.0 if value is None else value) if kind == "logf" else self.a
        return np.diag(w.sum(1)) - w

    def eig(self, kind: str = "laplacian", value: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        if (kind, value) not in self._eig:
            self._eig[kind, value] = np.linalg.eigh(self.matrix(kind, value))
        return self._eig[kind, value]

    def band(self, m: np.ndarray, d_min: int = 3, d_max: int | None = None) -> np.ndarray:
        inside = (self.hops >= max(1, d_min)) & (self.hops <= (d_max or self.n))
        return (m * inside).sum(1)

    def gauge_channels(self, field: float = 0.15, t: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
        """Phase locking and banded imaginary interference, the mean over both directions of the field."""
        if self.n > DENSE and self.is_path:
            from . import paths

            return paths.gauge_channels(self.nodes["x"].to_numpy(float), self.nodes["y"].to_numpy(float), field, t)
        # The other direction's Hamiltonian is the conjugate one, so its functions are the transposed ones.
        w, v = self.eig("gauge", field)
        x = w * t
        u, m = (of(w, v, f) for f in (np.exp(-1j * w * typical_time(w)), np.where(np.abs(x) > TINY, (1 - np.exp(-1j * x)) / (1j * np.where(np.abs(x) > TINY, x, 1)), 1)))
        lock = sum(np.abs(a.sum(1)) / (np.abs(a).sum(1) + 1e-12) for a in (u, u.T)) / 2
        band = self.band(np.abs(m.imag) + np.abs(m.T.imag)) / 2
        return lock, band


def per_structure(nodes: DataFrame, edges: DataFrame, function: Callable[[Structure], dict], schema: str) -> DataFrame:
    """Runs `function` once for each structure; it returns columns, to which structure_id is added."""

    def run(key: tuple, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        names = ["structure_id", *[c.split()[0].strip("`") for c in schema.split(", ")]]
        if not len(ns):
            return pd.DataFrame(columns=names)
        out = pd.DataFrame(function(Structure(ns, es)))
        out.insert(0, "structure_id", key[0])
        return out[names]

    return nodes.groupBy(S).cogroup(edges.select(F.col(S).alias("_of"), "i", "j").groupBy("_of")).applyInPandas(run, f"{S} string, {schema}")


def per_cloud(nodes: DataFrame, cutoff: float, function: Callable[[Structure], dict], schema: str) -> DataFrame:
    """As `per_structure`, on contact graphs that a task makes of its structure's points: their edges are never shuffled."""

    def run(key: tuple, ns: pd.DataFrame) -> pd.DataFrame:
        names = ["structure_id", *[c.split()[0].strip("`") for c in schema.split(", ")]]
        ids = ns["node_id"].to_numpy()
        a, b = contact_rows(ids, ns[["x", "y", "z"]].to_numpy(float), cutoff)
        out = pd.DataFrame(function(Structure(ns, pd.DataFrame({"i": ids[a], "j": ids[b]}))))
        out.insert(0, "structure_id", key[0])
        return out[names]

    return nodes.groupBy(S).applyInPandas(run, f"{S} string, {schema}")


def metric_rows(nodes: DataFrame, edges: DataFrame, metric: str, kind: str = "laplacian", value: float | None = None, **params) -> DataFrame:
    """(structure_id, i, j, v): all pairs of one metric, where a caller does need them."""
    f = METRICS[metric]

    def run(s: Structure) -> dict:
        m = f(*s.eig(kind, value), **params)
        return {"i": np.repeat(s.ids, s.n), "j": np.tile(s.ids, s.n), "v": m.ravel()}

    return per_structure(nodes, edges, run, "i long, j long, v double")


def row_sums(nodes: DataFrame, edges: DataFrame, metric: str, kind: str = "laplacian", value: float | None = None, **params) -> DataFrame:
    f = METRICS[metric]
    return per_structure(nodes, edges, lambda s: {"node_id": s.ids, "row_sum": f(*s.eig(kind, value), **params).sum(1)}, "node_id long, row_sum double")


def band_scores(nodes: DataFrame, edges: DataFrame, metric: str, kind: str = "laplacian", value: float | None = None, d_min: int = 3, d_max: int | None = None, **params) -> DataFrame:
    f = METRICS[metric]
    return per_structure(nodes, edges, lambda s: {"node_id": s.ids, "score": s.band(f(*s.eig(kind, value), **params), d_min, d_max)}, "node_id long, score double")


# Chebyshev series, as a recurrence of joins: for structures that are too large for a dense eigensystem.


def chebyshev(f: Callable, upper: float, k: int = 40, nodes: int = 200) -> list[float]:
    """Coefficients of f on [0, upper]."""
    x = (np.arange(nodes) + 0.5) * np.pi / nodes
    y = f(upper * (np.cos(x) + 1) / 2)
    c = [2.0 / nodes * float((y * np.cos(j * x)).sum()) for j in range(k)]
    c[0] /= 2
    return c


def apply_series(coo: DataFrame, start: DataFrame, coefficients: list[float], upper: float, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(structure_id, node_id, x): f(H) start, with H as (structure_id, i, j, v) and one checkpoint (`cut`) a step."""

    def times(t: DataFrame) -> DataFrame:
        moved = coo.join(t.select(S, F.col("node_id").alias("j"), "x"), [S, "j"]).groupBy(S, F.col("i").alias("node_id")).agg(F.sum(F.col("v") * F.col("x")).alias("hx"))
        return t.join(moved, [S, "node_id"], "left").select(S, "node_id", "x", (2.0 / upper * F.coalesce("hx", F.lit(0.0)) - F.col("x")).alias("lx"))

    first = times(start).select(S, "node_id", F.col("x").alias("t0"), F.col("lx").alias("t1"))
    state = first.withColumn("y", coefficients[0] * F.col("t0") + coefficients[1] * F.col("t1"))
    for c in coefficients[2:]:
        state = cut(state)
        nxt = times(state.select(S, "node_id", F.col("t1").alias("x"))).select(S, "node_id", "lx")
        state = state.join(nxt, [S, "node_id"]).select(S, "node_id", F.col("t1").alias("t0"), (2.0 * F.col("lx") - F.col("t0")).alias("t1"), "y")
        state = state.withColumn("y", F.col("y") + c * F.col("t1"))
    return state.select(S, "node_id", F.col("y").alias("x"))


def signs(ids: np.ndarray, probes: int) -> np.ndarray:
    """(N, probes) of -1 and 1, from the bits of a hash of a node's id: the same wherever they are drawn."""
    import hashlib

    bits = [int(hashlib.md5(f"{i}:{r}".encode()).hexdigest()[:8], 16) & 1 for i in ids.tolist() for r in range(probes)]
    return np.array(bits, float).reshape(len(ids), probes) * 2 - 1


def series_of(s: Structure, x: np.ndarray, f: Callable, k: int = 40) -> np.ndarray:
    """f(L) x by a Chebyshev series of k terms on [0, twice the largest degree], without an eigensystem."""
    lap, upper = s.matrix("laplacian"), 2 * max(1.0, s.degree.max(initial=0))
    c = chebyshev(f, upper, k)
    t0, t1 = x, 2 / upper * (lap @ x) - x
    y = c[0] * t0 + c[1] * t1
    for a in c[2:]:
        t0, t1 = t1, 2 * (2 / upper * (lap @ t1) - t1) - t0
        y = y + a * t1
    return y


def stochastic_pairs(s: Structure, f: Callable, k: int = 40, probes: int | None = None) -> np.ndarray:
    """Estimate of f(L) from random signs and a Chebyshev series; about six probes for each root of N, 40 to 400."""
    r = int(np.clip(6 * np.sqrt(s.n), 40, 400)) if probes is None else probes
    xi = signs(s.ids, r)
    return series_of(s, xi, f, k) @ xi.T / r


def stochastic_rowsum(s: Structure, f: Callable, k: int = 40) -> np.ndarray:
    """f(L) times ones: f(0), up to the truncation of the series."""
    return series_of(s, np.ones(s.n), f, k)
