"""Functions of a path's Laplacian and adjacency, without matrices: on a path modes are cosines and sines, so that each entry
of a function is two numbers of one series, and a series is one Fourier transform.

f(L)_ab = g(a - b) + g(a + b + 1) and f(A)_ab = g(a - b) - g(a + b + 2), with g even and periodic. Sums over far pairs are
whole rows' sums less those of near pairs. What holds for dense structures (`spectral.METRICS`) is tested to be the same.
"""

from __future__ import annotations

import numpy as np

from . import spectral

#: Entries of a row-wise pass that are made at once.
ENTRIES = 1 << 20


def eigenvalues(n: int, kind: str = "laplacian") -> np.ndarray:
    return 2 - 2 * np.cos(np.pi * np.arange(n) / n) if kind == "laplacian" else 2 * np.cos(np.pi * np.arange(1, n + 1) / (n + 1))


class Series:
    """The entries of one function, given by its values at the eigenvalues."""

    def __init__(self, values: np.ndarray, kind: str = "laplacian"):
        n = self.n = len(values)
        if kind == "laplacian":
            self.sign, self.shift, spread = 1, 1, np.concatenate([values, [0], values[:0:-1]])
        else:
            self.sign, self.shift, spread = -1, 2, np.concatenate([[0], values, [0], values[::-1]])
        self.g = np.fft.ifft(spread)
        self.g = self.g if np.iscomplexobj(values) else self.g.real

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.g[np.abs(a - b)] + self.sign * self.g[a + b + self.shift]

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi of the matrix."""
        n, view = self.n, np.lib.stride_tricks.sliding_window_view
        both = np.concatenate([self.g[n - 1 : 0 : -1], self.g[:n]])
        # Row a of the first part starts at n - 1 - a, of the second at a + shift.
        first = view(both, n)[n - hi : n - lo][::-1]
        return first + self.sign * view(self.g[lo + self.shift : hi - 1 + self.shift + n], n)

    def row_sums(self) -> np.ndarray:
        upto, a = np.concatenate([[0], np.cumsum(self.g)]), np.arange(self.n)
        return upto[a + 1] + upto[self.n - a] - self.g[0] + self.sign * (upto[a + self.shift + self.n] - upto[a + self.shift])

    def near(self, d_min: int, of=lambda v: v) -> np.ndarray:
        """Sums of `of` over a row's entries less than d_min steps away."""
        out = np.zeros(self.n, of(self.g[:1]).dtype)
        for d in range(1 - d_min, d_min):
            a = np.arange(max(0, -d), min(self.n, self.n - d))
            out[a] += of(self.at(a, a + d))
        return out

    def far(self, d_min: int) -> np.ndarray:
        return self.row_sums() - self.near(d_min)


def squared(v: np.ndarray) -> np.ndarray:
    return v.real**2 + v.imag**2


def band(n: int, metric: str, kind: str = "laplacian", d_min: int = 3, p: float = 0.0, t: float | None = None, steps: int = 64, m2: float = 0.5, beta: float | None = None) -> np.ndarray:
    """`spectral.metric_band` of a path of n nodes, over pairs of d_min steps and more."""
    w, lap = eigenvalues(n, kind), eigenvalues(n)
    long = 20.0 if t is None else t
    x, y = w * long, lap * long
    full = lambda z: np.abs(z) > spectral.TINY
    over = lambda top, z, at_zero: np.where(full(z), top / np.where(full(z), z, 1), at_zero)
    far = lambda values, k: Series(values, k).far(d_min)
    # A walk keeps its probability: far pairs have what near ones leave.
    walk = lambda time: 1.0 - Series(np.exp(-1j * w * time), kind).near(d_min, squared)
    times = np.linspace(long / steps, long, steps)
    heat = lambda: far(over(-np.expm1(-y), y, 1.0), "laplacian")
    sampled_heat = lambda: far(np.exp(-np.outer(times, lap)).mean(0), "laplacian")

    def endless() -> np.ndarray:
        """Squared modes against squared modes, as sums of cosines of doubled places."""
        if kind != "laplacian":
            raise ValueError(f"no closed form of endless times for {kind!r}")
        g = Series(np.where(np.arange(n) == 0, 0.5, 1.0) / n).g
        q, out = (lambda d: g[np.abs(d) % (2 * n)]), np.zeros(n)
        for d in range(1 - d_min, d_min):
            a = np.arange(max(0, -d), min(n, n - d))
            b = a + d
            out[a] += q(0 * a) + q(2 * a + 1) + q(2 * b + 1) + q(2 * (a - b)) / 2 + q(2 * (a + b + 1)) / 2
        return 1.0 - out

    if metric in ("classical", "classical_sampled"):
        return heat() if metric == "classical" else sampled_heat()
    if metric in ("time_avg", "ita", "contrast"):
        return endless() - (heat() if metric == "contrast" else 0.0)
    if metric in ("time_avg_sampled", "contrast_sampled"):
        return sum(walk(time) for time in times) / steps - (sampled_heat() if metric == "contrast_sampled" else 0.0)
    if metric == "coherent":
        return walk(spectral.typical_time(w) if t is None else t)
    if metric == "q_communicability":
        return walk(0.5 if beta is None else beta)
    if metric == "resistance":
        g = Series(spectral.positive_inverse(lap))
        a = np.arange(n)
        own = g.at(a, a)
        upto = np.concatenate([[0], np.cumsum(own)])
        low, high = np.maximum(0, a - d_min + 1), np.minimum(n, a + d_min)
        return 2 * g.far(d_min) - own * (n - (high - low)) - (upto[-1] - (upto[high] - upto[low]))
    if metric == "gnm":
        return far(spectral.positive_inverse(lap), "laplacian")
    if metric == "yukawa":
        return far(1 / (lap + m2), "laplacian")
    waves = {
        "interference": lambda: spectral.sinc(x), "quadrature": lambda: over(1 - np.cos(x), x, 0.0), "communicability": lambda: np.exp((0.15 if beta is None else beta) * w),
        "dephased": lambda: (1 - p) * spectral.sinc(x) + p * over(-np.expm1(-x), x, 1.0),
    }
    return far(waves[metric](), kind)


def gauge_channels(x: np.ndarray, y: np.ndarray, field: float = 0.15, t: float = 20.0, d_min: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """`Structure.gauge_channels` of a path through points, in its order: a field only turns phases, H = D L D*, so that entries
    are those of the Laplacian's functions, turned. All pairs are looked at, some rows at a time."""
    n = len(x)
    w = eigenvalues(n)
    full = np.abs(w * t) > spectral.TINY
    z = np.where(full, w * t, 1)
    u, f = Series(np.exp(-1j * w * spectral.typical_time(w))), Series(np.where(full, (np.sin(z) - 1j * (1 - np.cos(z))) / z, 1.0 + 0j))
    turn = np.exp(1j * np.concatenate([[0], np.cumsum(-field * (x[:-1] * y[1:] - y[:-1] * x[1:]))]))
    lock, far = np.zeros(n), np.zeros(n)
    step = max(1, ENTRIES // n)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        m = u.rows(lo, hi)
        lock[lo:hi] = (np.abs(m @ turn.conj()) + np.abs(m @ turn)) / 2 / (np.abs(m).sum(1) + 1e-12)
        m = f.rows(lo, hi)
        delta = turn[lo:hi, None] * turn.conj()[None, :]
        # The imaginary parts of the entries turned one way and the other.
        a, b = m.imag * delta.real, m.real * delta.imag
        s = np.abs(a + b) + np.abs(a - b)
        for k in range(hi - lo):
            s[k, max(0, lo + k - d_min + 1) : lo + k + d_min] = 0.0
        far[lo:hi] = s.sum(1) / 2
    return lock, far
