"""Walks and circuits on graphs: gate tables, one-excitation walks, and small state vectors in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import S
from .spectral import Structure, per_structure


def walk_gates(edges: DataFrame, time: float = 6.0, steps: int = 12, weight: str | None = None) -> DataFrame:
    """(structure_id, step, seq, op, q0, q1, theta): XX and YY rotations over every contact, in every time step."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = edges.filter("i < j").withColumn("e", F.row_number().over(Window.partitionBy(S).orderBy("i", "j")))
    gates = one.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("op", F.explode(F.array(F.lit("rxx"), F.lit("ryy"))))
    return gates.select(S, "step", (2 * F.col("e") - F.when(F.col("op") == "rxx", 1).otherwise(0)).alias("seq"), "op", F.col("i").alias("q0"), F.col("j").alias("q1"), (w * (time / steps)).alias("theta"))


def resources(gates: DataFrame) -> DataFrame:
    """Two-qubit gates, all gates with the first flip, and qubits, before any compilation."""
    q = gates.select(S, F.explode(F.array("q0", "q1")).alias("q")).groupBy(S).agg(F.countDistinct("q").alias("qubits"))
    return gates.groupBy(S).agg(F.count(F.lit(1)).alias("two_qubit"), (F.count(F.lit(1)) + 1).alias("gates")).join(q, S)


def exact_walk(a: np.ndarray, source: int, time: float) -> np.ndarray:
    w, v = np.linalg.eigh(a)
    return np.abs((v * np.exp(-1j * w * time)) @ v[source]) ** 2


def sparse_walk(i: np.ndarray, j: np.ndarray, n: int, source: int, time: float) -> np.ndarray:
    """As `exact_walk`, for the adjacency of edges stored in both directions: a Chebyshev series of the propagator on the range
    that the largest degree bounds, with as many terms as a double holds; memory for the edges only."""
    b = float(max(1, np.bincount(i, minlength=n).max(initial=0)))
    terms = int(b * abs(time)) + 40 + int(10 * (b * abs(time)) ** (1 / 3))
    x = np.cos((np.arange(2 * terms) + 0.5) * np.pi / (2 * terms))
    c = np.array([(np.exp(-1j * b * time * x) * np.cos(k * np.arccos(x))).mean() for k in range(terms)]) * np.where(np.arange(terms) == 0, 1, 2)
    times = lambda v: np.bincount(i, v[j], n) / b
    t0 = np.zeros(n)
    t0[source] = 1
    t1 = times(t0)
    psi = c[0] * t0 + c[1] * t1
    for a in c[2:]:
        t0, t1 = t1, 2 * times(t1) - t0
        psi = psi + a * t1
    return np.abs(psi) ** 2


def stepped_walk(a: np.ndarray, source: int, time: float, steps: int, flip: float = 0.0, g: np.random.Generator | None = None) -> np.ndarray:
    """The circuit restricted to one excitation: each contact's rotations mix two amplitudes.

    With `flip`, each gate is followed by a random phase flip on one of its nodes with that probability (a trajectory).
    """
    i, j = np.nonzero(np.triu(a))
    return stepped_pairs(i, j, a[i, j], len(a), source, time, steps, flip, g)


def stepped_pairs(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int, source: int, time: float, steps: int, flip: float = 0.0, g: np.random.Generator | None = None) -> np.ndarray:
    """`stepped_walk` over contacts (i < j, in order), without their matrix."""
    psi = [0j] * n
    psi[source] = 1 + 0j
    gates = list(zip(i.tolist(), j.tolist(), np.cos(weight * time / steps).tolist(), (-1j * np.sin(weight * time / steps)).tolist(), strict=True))
    for _ in range(steps):
        for a, b, c, s in gates:
            psi[a], psi[b] = c * psi[a] + s * psi[b], s * psi[a] + c * psi[b]
            if flip and g.random() < flip:
                psi[a if g.random() < 0.5 else b] *= -1
    return np.abs(np.array(psi)) ** 2


def walk_probabilities(nodes: DataFrame, edges: DataFrame, time: float = 6.0, steps: int = 12, flip: float = 0.0, runs: int = 1) -> DataFrame:
    """(structure_id, node_id, exact, circuit) of a walk from the node of the highest degree (ties: smaller id)."""

    def run(s: Structure) -> dict:
        source = int(s.degree.argmax())
        g = np.random.default_rng(0)
        i, j = np.divmod(np.unique(s.i * s.n + s.j), s.n)
        up = i < j
        noisy = sum(stepped_pairs(i[up], j[up], np.ones(int(up.sum())), s.n, source, time, steps, flip, g) for _ in range(runs)) / runs
        return {"node_id": s.ids, "exact": sparse_walk(i, j, s.n, source, time), "circuit": noisy}

    return per_structure(nodes, edges, run, "node_id long, exact double, circuit double")


def _apply(psi: np.ndarray, gate: np.ndarray, q: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(gate, psi, ([1], [q + 1])) if gate.ndim == 2 else np.einsum("bij,bj...->bi...", gate, np.moveaxis(psi, q + 1, 1)), 0 if gate.ndim == 2 else 1, q + 1)


def _ry(t: np.ndarray) -> np.ndarray:
    c, s = np.cos(t / 2), np.sin(t / 2)
    return np.stack([np.stack([c, -s], -1), np.stack([s, c], -1)], -2)


def _ring(psi: np.ndarray, n: int) -> np.ndarray:
    for q in range(n):
        t = (q + 1) % n
        if t == q:
            continue
        move = np.moveaxis(psi, (q + 1, t + 1), (1, 2)).copy()
        move[:, 1] = move[:, 1, ::-1]
        psi = np.moveaxis(move, (1, 2), (q + 1, t + 1))
    return psi


def variational(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(first qubit is 1) for rows x in [0, 1]: RY encoding, then layers theta (L, n) of RY and a ring of CNOTs."""
    b, n = x.shape
    psi = np.zeros((b, *[2] * n), complex)
    psi[(slice(None), *[0] * n)] = 1
    for q in range(n):
        psi = _apply(psi, _ry(np.pi * x[:, q]), q)
    for layer in theta:
        for q in range(n):
            psi = _apply(psi, np.broadcast_to(_ry(layer[q]), (b, 2, 2)), q)
        psi = _ring(psi, n)
    return (np.abs(psi[:, 1]) ** 2).reshape(b, -1).sum(1)


def reuploading(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """As `variational`, but every layer (L, 2, n) encodes the row anew before it rotates."""
    b, n = x.shape
    psi = np.zeros((b, *[2] * n), complex)
    psi[(slice(None), *[0] * n)] = 1
    for layer in theta:
        for q in range(n):
            psi = _apply(psi, _ry(np.pi * x[:, q] + layer[0, q]), q)
            z = np.exp(1j * layer[1, q] / 2 * np.array([-1, 1]))
            psi = np.moveaxis(np.moveaxis(psi, q + 1, -1) * z, -1, q + 1)
        psi = _ring(psi, n)
    return (np.abs(psi[:, 1]) ** 2).reshape(b, -1).sum(1)


def spsa(loss, start: np.ndarray, rounds: int = 60, a: float = 0.15, c: float = 0.1, seed: int = 0) -> np.ndarray:
    """Simultaneous perturbation descent with gains that fall as powers .602 and .101."""
    g, x = np.random.default_rng(seed), start.copy()
    for k in range(1, rounds + 1):
        d, ck = g.choice([-1.0, 1.0], x.shape), c / k**0.101
        x -= a / k**0.602 * (loss(x + ck * d) - loss(x - ck * d)) / (2 * ck) * d
    return x


def feature_states(x: np.ndarray, repeats: int = 2) -> np.ndarray:
    """State vectors (rows, 2**n) of the ZZ feature map of rows x."""
    b, n = x.shape
    bit = (np.arange(2**n)[:, None] >> np.arange(n)[None, :]) & 1
    z = 1 - 2 * bit
    phase = x @ z.T
    for i in range(n):
        for j in range(i + 1, n):
            phase = phase + ((np.pi - x[:, i]) * (np.pi - x[:, j]))[:, None] * (z[:, i] * z[:, j])[None, :]
    h = np.array([[1.0]])
    for _ in range(n):
        h = np.kron(np.array([[1, 1], [1, -1]]) / np.sqrt(2), h)
    psi = np.zeros((b, 2**n), complex)
    psi[:, 0] = 1
    for _ in range(repeats):
        psi = (psi @ h.T) * np.exp(-1j * phase)
    return psi


def quantum_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(feature_states(a).conj() @ feature_states(b).T) ** 2


def gate_lines(gates: DataFrame) -> DataFrame:
    """(structure_id, step, seq, line): a gate table as text, in the order that a device would run it."""
    line = F.format_string("%s q[%d], q[%d] theta=%.6f", "op", "q0", "q1", "theta")
    return gates.select(S, "step", "seq", line.alias("line")).orderBy(S, "step", "seq")


def train_reuploading(x: np.ndarray, y: np.ndarray, layers: int = 2, rounds: int = 30, rate: float = 0.1, seed: int = 0) -> np.ndarray:
    """Parameters of `reuploading` by Adam on the weighted cross entropy; gradients by shifts of a quarter turn."""
    theta = np.random.default_rng(seed).normal(0, 0.3, (layers, 2, x.shape[1]))
    weight = np.where(y > 0, (len(y) - y.sum()) / max(1.0, y.sum()), 1.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p = np.clip(reuploading(x, theta), 1e-6, 1 - 1e-6)
        slope = weight * (p - y) / (p * (1 - p)) / weight.sum()
        g = np.zeros_like(theta)
        for at in np.ndindex(theta.shape):
            up, down = theta.copy(), theta.copy()
            up[at] += np.pi / 2
            down[at] -= np.pi / 2
            g[at] = (slope * (reuploading(x, up) - reuploading(x, down)) / 2).sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta
