"""Spectral queries whose SQL can be wrong: graphs with known spectra, and matrix functions by repeated products.

On a path of n nodes the Laplacian's eigenvalues are 2 - 2 cos(pi k / n) with cosines as eigenvectors, and the
adjacency's are 2 cos(pi k / (n + 1)) with sines; on a ring both are known and all degrees are equal. There SQL sums
over modes. On nearest-neighbour graphs SQL multiplies matrices: exponentials by squaring, resolvents by Newton's
iteration.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..operators import blocks, clusters, features, graph, spectral
from ..operators.graph import S
from ..sources.points import embedding_nodes
from .catalogue import KDEG, KNN, NODES, REACH, SQL, query, structures, whole, with_

PATH = (
    NODES
    + """,
pn AS (SELECT label, node_id, is_active, x, y, row_number() OVER (PARTITION BY label ORDER BY node_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM nodes),
md AS (SELECT label, n, r AS k, 2.0::DOUBLE - 2.0::DOUBLE * cos(pi() * r / n) AS w FROM pn),
vec AS (SELECT p.label, p.node_id, p.r, p.n, p.is_active, m.k, m.w, sqrt((CASE WHEN m.k = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) / m.n) * cos(pi() * m.k * (p.r + 0.5::DOUBLE) / m.n) AS v FROM pn p JOIN md m USING (label)),
amd AS (SELECT label, n, r AS k, 2.0::DOUBLE * cos(pi() * (r + 1) / (n + 1)) AS w FROM pn),
avec AS (SELECT p.label, p.node_id, p.r, p.n, m.k, m.w, sqrt(2.0::DOUBLE / (m.n + 1)) * sin(pi() * (m.k + 1) * (p.r + 1) / (m.n + 1)) AS v FROM pn p JOIN amd m USING (label)),
ts AS (SELECT label, 1.0::DOUBLE / greatest(abs(quantile_cont(gap, 0.5)), 1e-6) AS t FROM (SELECT label, w - lag(w) OVER (PARTITION BY label ORDER BY w) AS gap FROM md) WHERE gap IS NOT NULL GROUP BY label)"""
)


def paths(spark, sf_dir, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """A path for each label: its nodes by id, each one in contact with the next."""
    n = embedding_nodes(spark, sf_dir, by_label=True, whole=whole)
    step = n.select(S, F.col("node_id").alias("i"), F.lead("node_id").over(Window.partitionBy(S).orderBy("node_id")).alias("j")).filter("j IS NOT NULL")
    return n, step.unionByName(step.select(S, F.col("j").alias("i"), F.col("i").alias("j")))


def whole_paths(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return paths(spark, sf_dir, whole=True)


def rings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same, closed to rings."""
    n, e = paths(spark, sf_dir)
    ends = n.groupBy(S).agg(F.min("node_id").alias("i"), F.max("node_id").alias("j"), F.count(F.lit(1)).alias("n")).filter("n > 2").drop("n")
    return n, e.unionByName(ends).unionByName(ends.select(S, F.col("j").alias("i"), F.col("i").alias("j")))


def _per_node(graph_of, f, cols: list[str], digits: int = 5):
    schema = "node_id long, " + ", ".join(f"`{c}` double" for c in cols)
    return lambda spark, sf_dir: spectral.per_structure(*graph_of(spark, sf_dir), f, schema).select("node_id", *[(F.round(f"`{c}`", digits) + 0.0).alias(c) for c in cols])


# Eigensystems


@query(with_(PATH, "SELECT CAST(label AS VARCHAR) AS structure_id, k, round(w, 6) + 0.0 AS w FROM md"))
def path_eigenvalues(spark, sf_dir):
    out = spectral.per_structure(*paths(spark, sf_dir), lambda s: {"k": np.arange(s.n), "w": s.eig()[0]}, "k long, w double")
    return out.select(S, "k", (F.round("w", 6) + 0.0).alias("w"))


@query(with_(PATH, "SELECT CAST(label AS VARCHAR) AS structure_id, round(t, 5) AS t FROM ts"))
def typical_time(spark, sf_dir):
    """Inverse of the median gap between eigenvalues."""
    out = spectral.per_structure(*paths(spark, sf_dir), lambda s: {"t": [spectral.typical_time(s.eig()[0])]}, "t double")
    return out.select(S, F.round("t", 5).alias("t"))


@query(with_(KDEG, "SELECT node_id, degree::DOUBLE AS first, (degree * degree + degree)::DOUBLE AS second FROM deg"))
def eigen_moments(spark, sf_dir):
    """Each node's modes, weighted by their eigenvalues: the diagonal of L and of its square."""
    return _per_node(structures, lambda s: {"node_id": s.ids, "first": (s.eig()[1] ** 2 @ s.eig()[0]), "second": (s.eig()[1] ** 2 @ s.eig()[0] ** 2)}, ["first", "second"])(spark, sf_dir)


@query(with_(KDEG, "SELECT node_id, degree::DOUBLE AS first, (degree * degree + degree)::DOUBLE AS second FROM deg"))
def eig_complex_moments(spark, sf_dir):
    """The same of the complex Hamiltonian in a field."""

    def run(s):
        w, v = s.eig("gauge", 0.15)
        p = np.abs(v) ** 2
        return {"node_id": s.ids, "first": p @ w, "second": p @ w**2}

    return _per_node(structures, run, ["first", "second"])(spark, sf_dir)


# Metrics on paths: band scores of f(H) and of squared propagators, summed over modes

FAR = "abs(a.r - b.r) >= 3"
FILTERS = {
    "classical": "CASE WHEN w * 20.0::DOUBLE > 1e-9 THEN (1.0 - exp(-w * 20.0::DOUBLE)) / (w * 20.0::DOUBLE) ELSE 1.0 END",
    "classical_sampled": "(SELECT avg(exp(-w * 20.0::DOUBLE * q / 64)) FROM range(1, 65) t(q))",
    "interference": "CASE WHEN w * 20.0::DOUBLE > 1e-9 THEN sin(w * 20.0::DOUBLE) / (w * 20.0::DOUBLE) ELSE 1.0 END",
    "quadrature": "CASE WHEN w * 20.0::DOUBLE > 1e-9 THEN (1.0 - cos(w * 20.0::DOUBLE)) / (w * 20.0::DOUBLE) ELSE 0.0 END",
    "gnm": "CASE WHEN w > 1e-9 THEN 1.0 / w ELSE 0.0 END",
    "yukawa": "1.0::DOUBLE / (w + 0.5)",
    "communicability": "exp(0.15::DOUBLE * w)",
}
FILTERS["dephased"] = f"0.75::DOUBLE * ({FILTERS['interference']}) + 0.25::DOUBLE * ({FILTERS['classical']})"
KINDS = {"communicability": "adjacency", "q_communicability": "adjacency"}
PARAMS = {"dephased": {"p": 0.25}}


def _band_of(matrix: str) -> str:
    return f"SELECT p.node_id, round(coalesce(sum(m), 0.0), 6) + 0.0 AS score FROM pn p LEFT JOIN ({matrix}) z ON z.i = p.node_id GROUP BY p.node_id"


def _of_filter(f: str, vec: str = "vec", where: str = FAR) -> str:
    return f"SELECT a.node_id AS i, b.node_id AS j, sum(a.v * b.v * a.f) AS m FROM (SELECT *, {f} AS f FROM {vec}) a JOIN {vec} b ON a.label = b.label AND a.k = b.k AND {where} GROUP BY 1, 2"


def _of_walk(t: str, vec: str = "vec", times: str = "", where: str = FAR) -> str:
    """|U(t)|^2 for each time; `times` gives the column t to rows of a, where it is not one of the structure's own."""
    u = f"SELECT a.node_id AS i, b.node_id AS j, {'q, ' if times else ''}sum(a.v * b.v * cos(a.w * {t})) AS re, sum(a.v * b.v * sin(a.w * {t})) AS im FROM {vec} a JOIN {vec} b ON a.label = b.label AND a.k = b.k AND {where} JOIN ts ON ts.label = a.label {times} GROUP BY ALL"
    return f"SELECT i, j, avg(re * re + im * im) AS m FROM ({u}) GROUP BY 1, 2"


_ITA = "SELECT a.node_id AS i, b.node_id AS j, sum(a.v * a.v * b.v * b.v) AS m FROM vec a JOIN vec b ON a.label = b.label AND a.k = b.k AND " + FAR + " GROUP BY 1, 2"
_TIMES = ", range(1, 65) g(q)"
MATRICES = {m: _of_filter(f, "avec" if m in KINDS else "vec") for m, f in FILTERS.items()} | {
    "time_avg": _ITA,
    "coherent": _of_walk("t"),
    "time_avg_sampled": _of_walk("20.0::DOUBLE * q / 64", times=_TIMES),
    "q_communicability": _of_walk("0.5::DOUBLE", "avec"),
    "contrast": f"SELECT i, j, x.m - y.m AS m FROM ({_ITA}) x JOIN ({_of_filter(FILTERS['classical'])}) y USING (i, j)",
    "contrast_sampled": f"SELECT i, j, x.m - y.m AS m FROM ({_of_walk('20.0::DOUBLE * q / 64', times=_TIMES)}) x JOIN ({_of_filter(FILTERS['classical_sampled'])}) y USING (i, j)",
    "resistance": f"SELECT i, j, 2 * x.m - p.d - q.d AS m FROM ({_of_filter(FILTERS['gnm'])}) x JOIN dg p ON p.node_id = i JOIN dg q ON q.node_id = j",
}
_DIAGONAL = f", dg AS (SELECT node_id, sum(v * v * {FILTERS['gnm']}) AS d FROM vec GROUP BY 1)"


#: Metrics whose paths hold all of a label's nodes.
ALL_NODES = ("time_avg_sampled",)


def _path_metric(metric: str):
    graph_of, said = (whole_paths, whole) if metric in ALL_NODES else (paths, str)

    def run(spark, sf_dir):
        f = lambda s: {"node_id": s.ids, "score": spectral.metric_band(s, metric, KINDS.get(metric, "laplacian"), **PARAMS.get(metric, {}))}
        return _per_node(graph_of, f, ["score"], 6)(spark, sf_dir)

    query(said(with_(PATH + _DIAGONAL, _band_of(MATRICES[metric]))), f"path_{metric}")(run)


for _m in MATRICES:
    _path_metric(_m)


@query(whole(with_(PATH + _DIAGONAL, " UNION ALL ".join(f"SELECT '{m}' AS metric, label, round(sum(score), 6) + 0.0 AS total FROM ({_band_of(q)}) JOIN pn USING (node_id) GROUP BY label" for m, q in MATRICES.items()).replace("label,", "CAST(label AS VARCHAR) AS structure_id,"))))
def metric_dispatch(spark, sf_dir):
    """Every named metric, by name: the sum of its band scores in each structure."""
    names = list(MATRICES)

    def run(s):
        return {"metric": names, "total": [float(spectral.metric_band(s, m, KINDS.get(m, "laplacian"), **PARAMS.get(m, {})).round(6).sum()) for m in names]}

    return spectral.per_structure(*whole_paths(spark, sf_dir), run, "metric string, total double").select(S, "metric", (F.round("total", 6) + 0.0).alias("total"))


# Channels on paths

_DIAG = {
    "eff_mass": "-ln(greatest(sum(v * v * exp(-w * 20.0::DOUBLE)), 1e-12)) / 20.0::DOUBLE",
    "commute": "sum(v * v * CASE WHEN w > 1e-9 THEN 1.0 / w ELSE 0.0 END)",
    "hks1": "sum(v * v * exp(-w * 1.0::DOUBLE))",
    "hks5": "sum(v * v * exp(-w * 5.0::DOUBLE))",
    "hks20": "sum(v * v * exp(-w * 20.0::DOUBLE))",
    "hks60": "sum(v * v * exp(-w * 60.0::DOUBLE))",
    "ipr": "sum(v * v * v * v)",
    "fiedler": "max(CASE WHEN k = 1 THEN abs(v) ELSE 0.0 END)",
    # Non-zero modes 1 .. n - 1, cut by their number.
    "p_low": "sum(CASE WHEN k BETWEEN 1 AND greatest(1, (n - 1) // 5) THEN v * v ELSE 0.0 END)",
    "p_mid": "sum(CASE WHEN k - 1 >= (n - 1) // 5 AND k - 1 < 3 * (n - 1) // 5 THEN v * v ELSE 0.0 END)",
    "p_high": "sum(CASE WHEN k - 1 >= 3 * (n - 1) // 5 THEN v * v ELSE 0.0 END)",
    "degree": "max(CASE WHEN r = 0 OR r = n - 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END)",
}
BANK12 = features.channel_names("bank12")

query(with_(PATH, "SELECT node_id, " + ", ".join(f"round({_DIAG[c]}, 5) + 0.0 AS {c}" for c in BANK12) + " FROM vec GROUP BY node_id"), "path_bank12")(_per_node(paths, lambda s: {"node_id": s.ids} | features.bank12(s), BANK12))

_BINS = ", bn AS (SELECT *, least(floor((w - min(w) OVER l) / (max(w) OVER l - min(w) OVER l + 1e-12) * 20.0::DOUBLE), 19.0)::BIGINT AS bin FROM vec WINDOW l AS (PARTITION BY label))"


@query(with_(PATH + _BINS, "SELECT node_id, bin, round(sum(v * v), 5) + 0.0 AS share FROM bn GROUP BY 1, 2"))
def path_participation(spark, sf_dir):
    """Each node's share in the bands of eigenvalues; bands without modes are left out."""

    def run(s):
        w, v = s.eig()
        p = spectral.participation(w, v)
        full = np.flatnonzero(p.sum(0) > 1e-12)
        return {"node_id": np.repeat(s.ids, len(full)), "bin": np.tile(full, s.n), "share": p[:, full].ravel()}

    return spectral.per_structure(*paths(spark, sf_dir), run, "node_id long, bin long, share double").select("node_id", "bin", (F.round("share", 5) + 0.0).alias("share"))


@query(with_(PATH, "SELECT i AS node_id, round(sqrt(sum(re) ** 2 + sum(im) ** 2) / (sum(sqrt(re * re + im * im)) + 1e-12), 5) AS coherence FROM (SELECT a.node_id AS i, b.node_id AS j, sum(a.v * b.v * cos(a.w * t)) AS re, -sum(a.v * b.v * sin(a.w * t)) AS im FROM vec a JOIN vec b ON a.label = b.label AND a.k = b.k JOIN ts ON ts.label = a.label GROUP BY 1, 2) GROUP BY i"))
def path_phase_coherence(spark, sf_dir):
    return _per_node(paths, lambda s: {"node_id": s.ids, "coherence": spectral.phase_coherence(*s.eig())}, ["coherence"])(spark, sf_dir)


_RESONANCE = """, span AS (SELECT label, least(4 * pi() / min(w) FILTER (WHERE w > 1e-9), {most}) AS tm, max(w) AS wm FROM md GROUP BY label),
grid AS (SELECT label, tm * q / (nt - 1) AS t FROM (SELECT label, tm, least(2000, greatest(64, ceil(tm * 2.0::DOUBLE * (wm + 1e-9) / pi())))::BIGINT AS nt FROM span), LATERAL (SELECT unnest(range(nt)) AS q)),
c AS (SELECT v.label, k, sum(v * {ref}) AS c FROM vec v GROUP BY 1, 2),
psi AS (SELECT v.node_id, g.t, sum(v.v * c.c * cos(v.w * g.t)) AS re, -sum(v.v * c.c * sin(v.w * g.t)) AS im FROM vec v JOIN c USING (label, k) JOIN grid g USING (label) GROUP BY 1, 2)"""


@query(with_(PATH + _RESONANCE.format(most="200.0::DOUBLE", ref="CAST(is_active AS INTEGER)"), "SELECT node_id, round(avg(re * re + im * im), 5) + 0.0 AS overlap FROM psi GROUP BY node_id"))
def path_resonance(spark, sf_dir):
    """What starts on the active nodes and is found on each node, over sampled times."""
    return _per_node(paths, lambda s: {"node_id": s.ids, "overlap": spectral.resonance(*s.eig(), s.nodes["is_active"].to_numpy(float))}, ["overlap"])(spark, sf_dir)


@query(with_(PATH + _RESONANCE.format(most="4.0::DOUBLE", ref="(1 + r)"), "SELECT node_id, round(sqrt(avg(re / (sqrt(re * re + im * im) + 1e-12)) ** 2 + avg(im / (sqrt(re * re + im * im) + 1e-12)) ** 2), 5) AS locking FROM psi GROUP BY node_id"))
def path_phase_locking(spark, sf_dir):
    """How steady each node's phase is over a short time, from a ramp along the path."""
    return _per_node(paths, lambda s: {"node_id": s.ids, "locking": spectral.phase_locking(*s.eig(), 1.0 + np.arange(s.n), 4.0)}, ["locking"])(spark, sf_dir)


# A field on a path only turns phases: H = D L D* with phases summed along it.
_GAUGE = """, fields AS (SELECT unnest([0.15::DOUBLE, -0.15::DOUBLE]) AS b),
steps AS (SELECT label, node_id, r, b, -b * (lag(x) OVER w * y - lag(y) OVER w * x) AS d FROM pn, fields WINDOW w AS (PARTITION BY label, b ORDER BY r)),
theta AS (SELECT node_id, b, coalesce(sum(d) OVER (PARTITION BY label, b ORDER BY r), 0.0) AS th FROM steps),
u AS (SELECT a.node_id AS i, b.node_id AS j, any_value(a.r) AS ri, any_value(b.r) AS rj, sum(a.v * b.v * cos(a.w * t)) AS re, -sum(a.v * b.v * sin(a.w * t)) AS im,
  sum(a.v * b.v * CASE WHEN a.w * 20 > 1e-9 THEN sin(a.w * 20) / (a.w * 20) ELSE 1.0 END) AS fr, -sum(a.v * b.v * CASE WHEN a.w * 20 > 1e-9 THEN (1 - cos(a.w * 20)) / (a.w * 20) ELSE 0.0 END) AS fi
  FROM vec a JOIN vec b ON a.label = b.label AND a.k = b.k JOIN ts ON ts.label = a.label GROUP BY 1, 2),
g AS (SELECT i, p.b, sqrt(sum(re * cos(p.th - q.th) - im * sin(p.th - q.th)) ** 2 + sum(re * sin(p.th - q.th) + im * cos(p.th - q.th)) ** 2) / (sum(sqrt(re * re + im * im)) + 1e-12) AS lock,
  sum(CASE WHEN abs(ri - rj) >= 3 THEN abs(fr * sin(p.th - q.th) + fi * cos(p.th - q.th)) ELSE 0.0 END) AS band
  FROM u JOIN theta p ON p.node_id = i JOIN theta q ON q.node_id = j AND q.b = p.b GROUP BY 1, 2)"""


@query(whole(with_(PATH + _GAUGE, "SELECT i AS node_id, round(avg(lock), 5) AS gauge_coh, round(avg(band), 5) + 0.0 AS gauge_interf FROM g GROUP BY i")))
def path_gauge(spark, sf_dir):
    def run(s):
        lock, band = s.gauge_channels()
        return {"node_id": s.ids, "gauge_coh": lock, "gauge_interf": band}

    return _per_node(whole_paths, run, ["gauge_coh", "gauge_interf"])(spark, sf_dir)


# Banks on rings, where every degree is two and so every logf weight is one: all channels but those that single out one
# of two equal modes.

_R = "2.0::DOUBLE - 2.0::DOUBLE * cos(2 * pi() * k / n)"
RING = NODES + f""",
pn AS (SELECT label, node_id, row_number() OVER (PARTITION BY label ORDER BY node_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM nodes),
rw AS (SELECT label, n, k, {_R} AS w, 2.0::DOUBLE * cos(2 * pi() * k / n) AS aw FROM (SELECT label, n, r AS k FROM pn)),
rt AS (SELECT label, 1.0::DOUBLE / greatest(abs(quantile_cont(gap, 0.5)), 1e-6) AS t FROM (SELECT label, w - lag(w) OVER (PARTITION BY label ORDER BY w) AS gap FROM rw) WHERE gap IS NOT NULL GROUP BY label),
rd AS (SELECT label, n, r AS d FROM pn)"""


def _ring(f: str, w: str = "w") -> str:
    """Sum over the ring, from the third neighbour on, of the circulant entries of f(w)."""
    return f"(SELECT sum(e) FROM (SELECT d, sum(cos(2 * pi() * k * d / n) * ({f.replace('w *', w + ' *')})) / n AS e FROM ring WHERE least(d, n - d) >= 3 GROUP BY d, n))"


_RING_BANK = {
    "interf": lambda t: f"CASE WHEN w * {t} > 1e-9 THEN sin(w * {t}) / (w * {t}) ELSE 1.0 END",
    "yukawa": lambda m: f"1.0::DOUBLE / (w + {m})",
}


def _ring_sum(f: str) -> str:
    return f"sum(CASE WHEN least(d, n - d) >= 3 THEN cos(2 * pi() * k * d / n) * ({f}) / n ELSE 0.0 END)"


def _ring_square(w: str, t: str) -> str:
    return f"(SELECT label, sum(re * re + im * im) AS e FROM (SELECT rd.label, d, sum(cos(2 * pi() * k * d / rd.n) * cos({w} * {t})) / rd.n AS re, sum(cos(2 * pi() * k * d / rd.n) * sin({w} * {t})) / rd.n AS im FROM rd JOIN rw USING (label) JOIN rt USING (label) WHERE least(d, rd.n - d) >= 3 GROUP BY rd.label, d, rd.n) GROUP BY label)"


_RING_COLUMNS = {
    "eff_mass": "-ln(sum(CASE WHEN d = 0 THEN exp(-w * 20.0::DOUBLE) / n ELSE 0.0 END)) / 20.0::DOUBLE",
    "commute": "sum(CASE WHEN d = 0 AND w > 1e-9 THEN 1.0 / (w * n) ELSE 0.0 END)",
    "hks5": "sum(CASE WHEN d = 0 THEN exp(-w * 5.0::DOUBLE) / n ELSE 0.0 END)",
    "hks20": "sum(CASE WHEN d = 0 THEN exp(-w * 20.0::DOUBLE) / n ELSE 0.0 END)",
    "hks60": "sum(CASE WHEN d = 0 THEN exp(-w * 60.0::DOUBLE) / n ELSE 0.0 END)",
    "degree": "2.0::DOUBLE",
    **{f"yukawa{m}": _ring_sum(_RING_BANK["yukawa"](m)) for m in (0.1, 0.5, 2.0)},
    **{f"interf_T{t}": _ring_sum(_RING_BANK["interf"](f"{t}.0::DOUBLE")) for t in (10, 20, 40)},
    "quadrature": _ring_sum("CASE WHEN w * 20.0::DOUBLE > 1e-9 THEN (1.0 - cos(w * 20.0::DOUBLE)) / (w * 20.0::DOUBLE) ELSE 0.0 END"),
}
_RING_SQL = RING + ", ring AS (SELECT rd.label, rd.n, d, k, w, aw FROM rd JOIN rw USING (label)), one AS (SELECT label, {cols} FROM ring GROUP BY label)" + f", co AS (SELECT label, e AS coherent FROM {_ring_square('w', 't')}), qc AS (SELECT label, e AS communic FROM {_ring_square('aw', '0.5::DOUBLE')})"


def _ring_bank(bank: str, keep: list[str]):
    return _per_node(rings, lambda s: {"node_id": s.ids} | {c: v for c, v in features.BANKS[bank](s).items() if c in keep}, keep)


_KEEP23 = [c for c in features.channel_names("bank23") if c in _RING_COLUMNS] + ["coherent", "communic"]
query(
    with_(_RING_SQL.replace("{cols}", ", ".join(f"{v} AS \"{c}\"" for c, v in _RING_COLUMNS.items())), "SELECT node_id, " + ", ".join(f"round(\"{c}\", 5) + 0.0 AS \"{c}\"" for c in _KEEP23) + " FROM pn JOIN one USING (label) JOIN co USING (label) JOIN qc USING (label)"),
    "ring_bank23",
)(_ring_bank("bank23", _KEEP23))

_KEEP13 = {"interf": "interf_T20", "quadrature": "quadrature", "eff_mass": "eff_mass", "commute": "commute", "hks20": "hks20", "degree": "degree"}
query(
    with_(_RING_SQL.replace("{cols}", ", ".join(f"{v} AS \"{c}\"" for c, v in _RING_COLUMNS.items())), "SELECT node_id, " + ", ".join(f"round(\"{v}\", 5) + 0.0 AS \"{c}\"" for c, v in _KEEP13.items()) + " FROM pn JOIN one USING (label)"),
    "ring_bank13",
)(_ring_bank("bank13", list(_KEEP13)))

_SIGNALS = {f"interf_s{s}_T{t}": _ring_sum(_RING_BANK["interf"](f"{t}.0::DOUBLE")) for s in (0.3, 0.6, 1.0, 1.6, 2.5) for t in (5, 15, 30, 60)}
_SIGNALS |= {f"yukawa_m{m}": _ring_sum(_RING_BANK["yukawa"](m)) for m in (0.1, 0.5, 2.0)} | {"eff_mass": _RING_COLUMNS["eff_mass"]}
_COHERENT29 = [f"coh_s{s}" for s in (0.3, 0.6, 1.0, 1.6, 2.5)]
query(
    with_(_RING_SQL.replace("{cols}", ", ".join(f"{v} AS \"{c}\"" for c, v in _SIGNALS.items())), "SELECT node_id, " + ", ".join([f"round(\"{c}\", 5) + 0.0 AS \"{c}\"" for c in _SIGNALS] + [f"round(coherent, 5) + 0.0 AS \"{c}\"" for c in _COHERENT29]) + " FROM pn JOIN one USING (label) JOIN co USING (label)"),
    "ring_signals29",
)(_ring_bank("bank29", [*_SIGNALS, *_COHERENT29]))

_LST = {f"interf_s{s}_T{t}": _ring_sum(_RING_BANK["interf"](f"{t}.0::DOUBLE")) for s in (0.5, 1.0, 2.0) for t in (10, 40)}
_LST |= {"yukawa": _ring_sum(_RING_BANK["yukawa"](0.5)), "eff_mass": _RING_COLUMNS["eff_mass"], "resonance": "2.0::DOUBLE", "degree": "2.0::DOUBLE", "centrality": "sum(CASE WHEN k = 0 THEN least(d, n - d) ELSE 0 END)::DOUBLE / any_value(n)"}
_COHERENT14 = [f"coh_s{s}" for s in (0.5, 1.0, 2.0)]
query(
    with_(_RING_SQL.replace("{cols}", ", ".join(f"{v} AS \"{c}\"" for c, v in _LST.items())), "SELECT node_id, " + ", ".join([f"round(\"{c}\", 5) + 0.0 AS \"{c}\"" for c in _LST] + [f"round(coherent, 5) + 0.0 AS \"{c}\"" for c in _COHERENT14]) + " FROM pn JOIN one USING (label) JOIN co USING (label)"),
    "ring_lst14",
)(_ring_bank("bank14", [*_LST, *_COHERENT14]))

_EARLY = {"LST_interf": _RING_COLUMNS["interf_T20"], "classical": _ring_sum(FILTERS["classical"]), "degree": "2.0::DOUBLE", "centrality": _LST["centrality"]}
query(
    with_(
        _RING_SQL.replace("{cols}", ", ".join(f"{v} AS \"{c}\"" for c, v in _EARLY.items())),
        "SELECT node_id, " + ", ".join([f"round(\"{c}\", 5) + 0.0 AS \"{c}\"" for c in _EARLY] + ["round(coherent, 5) + 0.0 AS coherent", "round(communic, 5) + 0.0 AS q_communic"]) + " FROM pn JOIN one USING (label) JOIN co USING (label) JOIN qc USING (label)",
    ),
    "ring_early6",
)(_ring_bank("early6", [*_EARLY, "coherent", "q_communic"]))


# Nearest-neighbour graphs, by products of matrices


def _product(out: str, a: str, b: str, values: dict[str, str]) -> str:
    return f"{out} AS MATERIALIZED (SELECT a.i, b.j, " + ", ".join(f"sum({v}) AS {k}" for k, v in values.items()) + f" FROM {a} a JOIN {b} b ON a.j = b.i GROUP BY 1, 2)"


def exponentials(lap: str, t: float, rounds: int) -> tuple[str, str]:
    """SQL for tables e0 .. e`rounds` of functions of x = lap t / 2^(rounds - k): cos, sin, exp(-x), and the means of cos and
    exp(-x) from 0 to x; `lap` is a table (i, j, v) of all pairs within structures. Returns it with the last table's name."""
    scale = t / 2.0**rounds
    parts = [f"x1 AS MATERIALIZED (SELECT i, j, v * {scale!r}::DOUBLE AS x FROM {lap})"]
    for k in range(2, 7):
        parts.append(_product(f"x{k}", f"x{k - 1}", "x1", {"x": "a.x * b.x"}))
    joins = " ".join(f"JOIN x{k} USING (i, j)" for k in range(2, 7))
    one = "CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    parts.append(
        f"""e0 AS MATERIALIZED (SELECT i, j, {one} - x2.x / 2 + x4.x / 24 - x6.x / 720 AS c, x1.x - x3.x / 6 + x5.x / 120 AS s,
  {one} - x1.x + x2.x / 2 - x3.x / 6 + x4.x / 24 - x5.x / 120 + x6.x / 720 AS h, {one} - x2.x / 6 + x4.x / 120 - x6.x / 5040 AS f,
  {one} - x1.x / 2 + x2.x / 6 - x3.x / 24 + x4.x / 120 - x5.x / 720 + x6.x / 5040 AS g FROM x1 {joins})"""
    )
    for k in range(rounds):
        parts.append(
            _product(f"e{k + 1}", f"e{k}", f"e{k}", {"c": "a.c * b.c - a.s * b.s", "s": "2 * a.s * b.c", "h": "a.h * b.h", "f": "a.f * b.c", "g": "a.g * (b.h + CASE WHEN b.i = b.j THEN 1 ELSE 0 END) / 2", "q": "a.s * b.f"})
        )
    return ", " + ",\n".join(parts), f"e{rounds}"


PAIRS = REACH + ", pair AS (SELECT a.node_id AS i, b.node_id AS j FROM nodes a JOIN nodes b USING (label))"
LAPLACIAN = PAIRS + ", kd AS (SELECT i AS node_id, count(*) AS degree FROM knn GROUP BY 1), lap AS MATERIALIZED (SELECT p.i, p.j, CASE WHEN p.i = p.j THEN d.degree ELSE 0 END::DOUBLE - CASE WHEN k.i IS NULL THEN 0 ELSE 1 END AS v FROM pair p JOIN kd d ON d.node_id = p.i LEFT JOIN knn k ON k.i = p.i AND k.j = p.j)"
LOGF_LAP = PAIRS + """, kd AS (SELECT i AS node_id, count(*) AS degree FROM knn GROUP BY 1),
wt AS (SELECT k.i, k.j, exp(-((ln(a.degree + 1.0::DOUBLE) - ln(b.degree + 1.0::DOUBLE)) ** 2) / 2.0::DOUBLE) AS w FROM knn k JOIN kd a ON a.node_id = k.i JOIN kd b ON b.node_id = k.j),
ws AS (SELECT i, sum(w) AS d FROM wt GROUP BY 1),
lap AS MATERIALIZED (SELECT p.i, p.j, CASE WHEN p.i = p.j THEN d.d ELSE 0.0 END - coalesce(wt.w, 0.0) AS v FROM pair p JOIN ws d ON d.i = p.i LEFT JOIN wt ON wt.i = p.i AND wt.j = p.j)"""
ADJACENCY = PAIRS + ", lap AS MATERIALIZED (SELECT p.i, p.j, CASE WHEN k.i IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM pair p LEFT JOIN knn k ON k.i = p.i AND k.j = p.j)"
#: Exact for the band of 3 hops or more: pairs without a path are in no band.
BAND = "SELECT n.node_id, round(coalesce(sum({v}) FILTER (WHERE d >= 3), 0.0), 5) + 0.0 AS score FROM nodes n LEFT JOIN {e} m ON m.i = n.node_id LEFT JOIN gdist g ON g.i = m.i AND g.j = m.j GROUP BY n.node_id"
_NODE = "node_id long, score double"


def _knn_band(name: str, base: str, t: float, value: str, f, rounds: int = 16) -> None:
    sql, last = exponentials("lap", t, rounds)
    query(with_(base + sql, BAND.format(v=value, e=last)), name)(_per_node(structures, f, ["score"]))


_knn_band("knn_interference", LOGF_LAP, 20.0, "m.f", lambda s: {"node_id": s.ids, "score": s.band(spectral.interference(*s.eig("logf", 1.0)))})
_knn_band("knn_quadrature", LOGF_LAP, 20.0, "m.q", lambda s: {"node_id": s.ids, "score": s.band(spectral.quadrature(*s.eig("logf", 1.0)))})
_knn_band("knn_classical", LAPLACIAN, 20.0, "m.g", lambda s: {"node_id": s.ids, "score": s.band(spectral.heat_average(*s.eig()))})
_knn_band("knn_coherent", LAPLACIAN, 1.5, "m.c * m.c + m.s * m.s", lambda s: {"node_id": s.ids, "score": s.band(spectral.coherent(*s.eig(), 1.5))}, 12)
_knn_band("knn_q_communicability", ADJACENCY, 0.5, "m.c * m.c + m.s * m.s", lambda s: {"node_id": s.ids, "score": s.band(spectral.q_communicability(*s.eig("adjacency")))}, 10)
_knn_band("knn_communicability", ADJACENCY, -0.15, "m.h", lambda s: {"node_id": s.ids, "score": s.band(spectral.communicability(*s.eig("adjacency")))}, 8)
_knn_band("knn_dephased", LOGF_LAP, 20.0, "0.5 * m.f + 0.5 * m.g", lambda s: {"node_id": s.ids, "score": s.band(spectral.dephased(*s.eig("logf", 1.0), 0.5))})


def _newton(shift: str, top: str, rounds: int) -> str:
    """SQL for tables z0 .. z`rounds`: Newton's iteration for the inverse of lap + shift, from the identity over `top`."""
    parts = [f"am AS MATERIALIZED (SELECT i, j, v + {shift} AS v FROM lap)", f"z0 AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE / {top} ELSE 0.0::DOUBLE END AS v FROM lap)"]
    for k in range(rounds):
        parts.append(_product(f"y{k}", "am", f"z{k}", {"v": "a.v * b.v"}))
        parts.append(f"z{k + 1} AS MATERIALIZED (SELECT i, j, 2 * z.v - w.v AS v FROM z{k} z JOIN (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM z{k} a JOIN y{k} b ON a.j = b.i GROUP BY 1, 2) w USING (i, j))")
    return ", " + ",\n".join(parts)


_TOP = "(SELECT 2.0::DOUBLE * max(degree) + 1 FROM kd)"
query(with_(LAPLACIAN + _newton("CASE WHEN i = j THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END", _TOP, 13), BAND.format(v="m.v", e="z13")), "knn_yukawa")(_per_node(structures, lambda s: {"node_id": s.ids, "score": s.band(spectral.yukawa(*s.eig()))}, ["score"]))
# The pseudo-inverse: the inverse after each component's constant mode is lifted to one, less that mode.
_SIZED = LAPLACIAN + ", cs AS (SELECT i, count(*) AS size FROM gdist GROUP BY 1), mode AS (SELECT g.i, g.j, 1.0::DOUBLE / size AS u FROM gdist g JOIN cs USING (i))"
_LIFT = "coalesce((SELECT u FROM mode m WHERE m.i = lap.i AND m.j = lap.j), 0.0)"
_GNM = _SIZED + _newton(_LIFT, _TOP, 18) + ", gi AS MATERIALIZED (SELECT z.i, z.j, z.v - coalesce(m.u, 0.0) AS v FROM z18 z LEFT JOIN mode m ON m.i = z.i AND m.j = z.j)"
query(with_(_GNM, BAND.format(v="m.v", e="gi")), "knn_gnm")(_per_node(structures, lambda s: {"node_id": s.ids, "score": s.band(spectral.pseudo_inverse(*s.eig()))}, ["score"]))
query(with_(_GNM + ", rs AS (SELECT m.i, m.j, 2 * m.v - a.v - b.v AS v FROM gi m JOIN gi a ON a.i = m.i AND a.j = m.i JOIN gi b ON b.i = m.j AND b.j = m.j)", BAND.format(v="m.v", e="rs")), "knn_resistance")(
    _per_node(structures, lambda s: {"node_id": s.ids, "score": s.band(spectral.resistance(*s.eig()))}, ["score"])
)

# Queries of the catalogue that this SQL says as well
SQL["band_interference"], SQL["band_quadrature"] = SQL["knn_interference"], SQL["knn_quadrature"]
_HEAT, _HLAST = exponentials("lap", 20.0, 16)
SQL["heat_commute_mass"] = with_(_GNM + _HEAT, f"SELECT e.i AS node_id, round(e.h, 5) + 0.0 AS hks, round(g.v, 5) + 0.0 AS commute, round(-ln(greatest(e.h, 1e-12)) / 20, 5) + 0.0 AS eff_mass FROM {_HLAST} e JOIN gi g ON g.i = e.i AND g.j = e.j WHERE e.i = e.j")

# Chebyshev series: SQL makes the same coefficients and walks the same recurrence.
K, POINTS = 12, 200


def _series(terms: int) -> str:
    return LAPLACIAN + f""", up AS (SELECT label, 2.0::DOUBLE * max(degree) AS b FROM kd JOIN nodes USING (node_id) GROUP BY label),
cf AS (SELECT label, k, CASE WHEN k = 0 THEN 1 ELSE 2 END / {POINTS}.0::DOUBLE * sum(1.0::DOUBLE / (b * (cos((q + 0.5::DOUBLE) * pi() / {POINTS}) + 1) / 2 + 0.5) * cos(k * (q + 0.5::DOUBLE) * pi() / {POINTS})) AS c
  FROM up, range({terms}) a(k), range({POINTS}) g(q) GROUP BY label, k),
ll AS MATERIALIZED (SELECT l.i, l.j, 2 / b * l.v - CASE WHEN l.i = l.j THEN 1 ELSE 0 END AS v FROM lap l JOIN nodes n ON n.node_id = l.i JOIN up USING (label))"""


_SERIES = _series(K)


def _recurrence(start: str, terms: int = K) -> str:
    """Tables t0 .. of (node_id, x), from `start`, a query of (node_id, p, x); p tells vectors apart."""
    parts = [f"t0 AS MATERIALIZED ({start})", "t1 AS MATERIALIZED (SELECT l.i AS node_id, p, sum(l.v * t.x) AS x FROM ll l JOIN t0 t ON t.node_id = l.j GROUP BY 1, 2)"]
    for k in range(2, terms):
        parts.append(f"t{k} AS MATERIALIZED (SELECT node_id, p, 2 * n.x - o.x AS x FROM (SELECT l.i AS node_id, p, sum(l.v * t.x) AS x FROM ll l JOIN t{k - 1} t ON t.node_id = l.j GROUP BY 1, 2) n JOIN t{k - 2} o USING (node_id, p))")
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM t{k}" for k in range(terms))
    return ", " + ", ".join(parts) + f", y AS (SELECT t.node_id, p, sum(c * t.x) AS x FROM ({every}) t JOIN nodes n ON n.node_id = t.node_id JOIN cf ON cf.label = n.label AND cf.k = t.k GROUP BY 1, 2)"


def _screened(x):
    return 1 / (x + 0.5)


@query(with_(_SERIES, "SELECT CAST(label AS VARCHAR) AS structure_id, k, round(c, 6) + 0.0 AS c FROM cf"))
def cheb_coefficients(spark, sf_dir):
    run = lambda s: {"k": np.arange(K), "c": spectral.chebyshev(_screened, 2 * s.degree.max(), K)}
    return spectral.per_structure(*structures(spark, sf_dir), run, "k long, c double").select(S, "k", (F.round("c", 6) + 0.0).alias("c"))


_ONE_RANGE = _SERIES.replace("SELECT label, 2.0::DOUBLE * max(degree) AS b FROM kd JOIN nodes USING (node_id) GROUP BY label", "SELECT DISTINCT label, (SELECT 2.0::DOUBLE * max(degree) FROM kd) AS b FROM nodes")


@query(with_(_ONE_RANGE + _recurrence("SELECT node_id, 0 AS p, x FROM nodes"), "SELECT node_id, round(x, 5) + 0.0 AS x FROM y"))
def cheb_apply(spark, sf_dir):
    """A screened propagator times the first coordinate, by a recurrence of joins with a checkpoint each step."""
    n, e = structures(spark, sf_dir)
    n, e = cut_lineage(n.select(S, "node_id", "x", "y", "z")), cut_lineage(e)
    upper = 2.0 * graph.degrees(n, e).agg(F.max("degree")).first()[0]
    out = spectral.apply_series(graph.hamiltonian(n, e), n.select(S, "node_id", "x"), spectral.chebyshev(_screened, upper, K), upper, cut_lineage)
    return out.select("node_id", (F.round("x", 5) + 0.0).alias("x"))


@query(with_(_SERIES + _recurrence("SELECT node_id, 0 AS p, 1.0::DOUBLE AS x FROM nodes"), "SELECT node_id, round(x, 5) + 0.0 AS row_sum FROM y"))
def stochastic_rowsum(spark, sf_dir):
    return _per_node(structures, lambda s: {"node_id": s.ids, "row_sum": spectral.stochastic_rowsum(s, _screened, K)}, ["row_sum"])(spark, sf_dir)


# Probes by a structure's size, and terms, as many as the reference project takes.
TERMS40 = 40
_PROBES = "SELECT node_id, p, (('0x' || substr(md5(node_id || ':' || p), 1, 8))::BIGINT & 1) * 2.0::DOUBLE - 1 AS x FROM nodes JOIN pr USING (label), LATERAL (SELECT unnest(range(probes)) AS p)"
_COUNTED = ", pr AS (SELECT label, least(400, greatest(40, floor(6 * sqrt(count(*)))))::BIGINT AS probes FROM nodes GROUP BY label)"


@query(with_(_series(TERMS40) + _COUNTED + _recurrence(_PROBES, TERMS40), f", est AS (SELECT y.node_id AS i, z.node_id AS j, sum(y.x * z.x) / any_value(probes) AS m FROM y JOIN nodes n ON n.node_id = y.node_id JOIN t0 z ON z.p = y.p JOIN nodes o ON o.node_id = z.node_id AND o.label = n.label JOIN pr ON pr.label = n.label GROUP BY 1, 2) " + BAND.format(v="m.m", e="est")))
def stochastic_connectivity(spark, sf_dir):
    """Band scores of the screened propagator as estimated from random signs."""
    n, e = structures(spark, sf_dir)
    out = blocks.stochastic_band(n, cut_lineage(e), _screened, TERMS40)
    return out.select("node_id", (F.round("score", 5) + 0.0).alias("score"))


@query(with_(PATH, "SELECT CAST(label AS VARCHAR) AS structure_id, k::INTEGER AS k, round(w, 6) + 0.0 AS w FROM md WHERE k < 6"))
def path_low_modes(spark, sf_dir):
    """The six least eigenvalues of each path, by subspace iteration over nodes that lie on any tasks."""
    w, _ = blocks.low_modes(*paths(spark, sf_dir))
    return w.select(S, "k", (F.round("w", 6) + 0.0).alias("w"))


# Clusters that are known: points in blobs far apart.


@query(with_(NODES, "SELECT node_id, dense_rank() OVER (ORDER BY least) - 1 AS cluster_id FROM (SELECT node_id, min(node_id) OVER (PARTITION BY lab) AS least FROM nodes)"))
def blob_clusters(spark, sf_dir):
    """k-means of points in as many blobs as there are labels."""
    n = embedding_nodes(spark, sf_dir)
    far = lambda c, s: F.col(c) + 5000.0 * F.sin(F.col("label") * s)
    v = n.select(S, "node_id", F.array(far("x", 1.0), far("y", 2.3), far("z", 3.1)).alias("v"))
    return clusters.kmeans(v, n.select("label").distinct().count(), chunk=200).select("node_id", "cluster_id")
