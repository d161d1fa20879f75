"""Banks of node channels: one pass over a structure's eigensystems gives all columns of a bank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spectral as sp
from ..functions import inverse_normal
from .graph import S


def bank13(s: sp.Structure) -> dict:
    low, mid, high = sp.thirds(*(e := s.eig()))
    f = s.eig("logf", 1.0)
    lock, chiral = s.gauge_channels()
    return {
        "p_low": low, "p_mid": mid, "p_high": high, "fiedler": fiedler(*e), "eff_mass": sp.effective_mass(*e), "commute": sp.commute(*e), "hks20": sp.heat_kernel(*e), "degree": s.degree,
        "interf": s.band(sp.interference(*f)), "quadrature": s.band(sp.quadrature(*f)), "phase_coh": sp.phase_coherence(*f), "gauge_coh": lock, "gauge_interf": chiral,
    }


def fiedler(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    i = np.flatnonzero(w > sp.TINY)
    return np.abs(v[:, i[0]]) if len(i) else np.zeros(len(v))


def bank23(s: sp.Structure) -> dict:
    low, mid, high = sp.thirds(*(e := s.eig()))
    f = s.eig("logf", 1.0)
    lock, chiral = s.gauge_channels()
    out = {"p_low": low, "p_mid": mid, "p_high": high, "fiedler": fiedler(*e), "eff_mass": sp.effective_mass(*e), "commute": sp.commute(*e)}
    out |= {f"hks{t}": sp.heat_kernel(*e, float(t)) for t in (5, 20, 60)}
    out |= {"ipr": (e[1] ** 4).sum(1), "degree": s.degree}
    out |= {f"yukawa{m}": s.band(sp.yukawa(*e, m)) for m in (0.1, 0.5, 2.0)}
    out |= {f"interf_T{t}": s.band(sp.interference(*f, float(t))) for t in (10, 20, 40)}
    out |= {"quadrature": s.band(sp.quadrature(*f)), "phase_coh": sp.phase_coherence(*f), "coherent": s.band(sp.coherent(*f))}
    out |= {"communic": s.band(sp.q_communicability(*s.eig("adjacency"))), "gauge_coh": lock, "gauge_interf": chiral}
    return out


def bank12(s: sp.Structure) -> dict:
    """For nearest-neighbour graphs; standardised by the caller."""
    low, mid, high = sp.thirds(*(e := s.eig()))
    out = {"p_low": low, "p_mid": mid, "p_high": high, "fiedler": fiedler(*e), "eff_mass": sp.effective_mass(*e), "degree": s.degree}
    return out | {f"hks{t}": sp.heat_kernel(*e, float(t)) for t in (1, 5, 20, 60)} | {"commute": sp.commute(*e), "ipr": (e[1] ** 4).sum(1)}


def bank29(s: sp.Structure) -> dict:
    out = {}
    for sigma in (0.3, 0.6, 1.0, 1.6, 2.5):
        f = s.eig("logf", sigma)
        out |= {f"interf_s{sigma}_T{t}": s.band(sp.interference(*f, float(t))) for t in (5, 15, 30, 60)} | {f"coh_s{sigma}": s.band(sp.coherent(*f))}
    e = s.eig()
    return out | {f"yukawa_m{m}": s.band(sp.yukawa(*e, m)) for m in (0.1, 0.5, 2.0)} | {"eff_mass": sp.effective_mass(*e)}


def bank14(s: sp.Structure) -> dict:
    out = {}
    for sigma in (0.5, 1.0, 2.0):
        f = s.eig("logf", sigma)
        out |= {f"interf_s{sigma}_T{t}": s.band(sp.interference(*f, float(t))) for t in (10, 40)} | {f"coh_s{sigma}": s.band(sp.coherent(*f))}
    e, reach = s.eig(), s.hops >= 0
    out |= {"yukawa": s.band(sp.yukawa(*e)), "eff_mass": sp.effective_mass(*e), "resonance": s.weights(1.0).sum(1), "degree": s.degree}
    return out | {"centrality": np.where(reach, s.hops, 0).sum(1) / reach.sum(1)}


def early6(s: sp.Structure) -> dict:
    """The small bank of the first circuits, for contact graphs; standardised and squashed by the caller."""
    e, reach = s.eig(), s.hops >= 0
    out = {"LST_interf": s.band(sp.interference(*s.eig("logf", 1.0))), "coherent": s.band(sp.coherent(*e)), "q_communic": s.band(sp.q_communicability(*s.eig("adjacency")))}
    return out | {"classical": s.band(sp.heat_average(*e)), "degree": s.degree, "centrality": np.where(reach, s.hops, 0).sum(1) / reach.sum(1)}


BANKS = {"early6": early6, "bank12": bank12, "bank13": bank13, "bank14": bank14, "bank23": bank23, "bank29": bank29}
_NAMES: dict[str, list[str]] = {}


def channel_names(bank: str) -> list[str]:
    """A bank's columns, read off a small path graph."""
    if bank not in _NAMES:
        import pandas as pd

        ids = np.arange(12)
        s = sp.Structure(pd.DataFrame({"node_id": ids, "x": ids * 1.0, "y": ids % 3 * 1.0, "z": 0.0}), pd.DataFrame({"i": np.r_[ids[:-1], ids[1:]], "j": np.r_[ids[1:], ids[:-1]]}))
        _NAMES[bank] = list(BANKS[bank](s))
    return _NAMES[bank]


def feature_bank(nodes: DataFrame, edges: DataFrame, bank: str = "bank23") -> DataFrame:
    """(structure_id, node_id, a column for each channel)."""
    f = BANKS[bank]
    columns = ", ".join(f"`{c}` double" for c in channel_names(bank))
    return sp.per_structure(nodes, edges, lambda s: {"node_id": s.ids} | f(s), f"node_id long, {columns}")


# Transforms, within structures


def zscore(x: DataFrame, cols: list[str]) -> DataFrame:
    w = Window.partitionBy(S)
    return x.select(*[c for c in x.columns if c not in cols], *[((F.col(f"`{c}`") - F.avg(f"`{c}`").over(w)) / (F.stddev_pop(f"`{c}`").over(w) + 1e-9)).alias(c) for c in cols])


def tanh_squash(x: DataFrame, cols: list[str]) -> DataFrame:
    z = zscore(x, cols)
    return z.select(*[c for c in x.columns if c not in cols], *[F.tanh(f"`{c}`").alias(c) for c in cols])


def rank_gauss(x: DataFrame, cols: list[str]) -> DataFrame:
    """Normal quantiles of row numbers; ties by id."""
    n = F.count(F.lit(1)).over(Window.partitionBy(S))
    u = lambda c: (F.row_number().over(Window.partitionBy(S).orderBy(F.col(f"`{c}`"), "node_id")) - 0.5) / n
    return x.select(*[c for c in x.columns if c not in cols], *[inverse_normal(F.least(F.greatest(u(c), F.lit(1e-6)), F.lit(1 - 1e-6))).alias(c) for c in cols])


def whiten(x: DataFrame, cols: list[str]) -> DataFrame:
    """Columns without correlation and of unit variance within each structure (sample covariance)."""

    def run(key, pdf):
        import pandas as pd

        v = pdf[cols].to_numpy(float)
        v = v - v.mean(0)
        c = np.cov(v, rowvar=False).reshape(len(cols), len(cols)) + 1e-6 * np.eye(len(cols))
        w, u = np.linalg.eigh(c)
        return pd.DataFrame(v @ (u / np.sqrt(np.clip(w, 1e-9, None))) @ u.T, columns=cols).assign(structure_id=key[0], node_id=pdf["node_id"].to_numpy())[[S, "node_id", *cols]]

    return x.select(S, "node_id", *[f"`{c}`" for c in cols]).groupBy(S).applyInPandas(run, f"{S} string, node_id long, " + ", ".join(f"`{c}` double" for c in cols))


TRANSFORMS = {"zscore": zscore, "rank_gauss": rank_gauss, "whiten": whiten, "tanh": tanh_squash}


def register_transform(name: str, function) -> None:
    TRANSFORMS[name] = function


def library(x: DataFrame, cols: list[str]) -> DataFrame:
    """Channels, their squares and products of pairs, standardised."""
    terms = {c: F.col(f"`{c}`") for c in cols} | {f"{c}^2": F.col(f"`{c}`") * F.col(f"`{c}`") for c in cols}
    terms |= {f"{a}*{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for k, a in enumerate(cols) for b in cols[k + 1 :]}
    return zscore(x.select(S, "node_id", *[v.alias(k) for k, v in terms.items()]), list(terms))
