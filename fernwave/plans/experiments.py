"""Named detectors, run together: each structure's eigensystems are made once, whatever number of detectors use them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import significant_array
from ..functions.lineage import cut_lineage
from ..operators import features, graph, learned, ranking, scoring, spectral
from ..operators.graph import S


@dataclass(frozen=True)
class Detector:
    name: str
    metric: str
    kind: str = "laplacian"
    value: float | None = None
    ranking: str = "band"  # band, or an active-site normalisation: none, zscore, zabs, distance
    params: dict = field(default_factory=dict)
    #: Several settings (kind's value, metric's parameters) whose orders are averaged.
    scales: tuple = ()


# The grid of detectors, with bands of 3 to 8 hops.
D_MIN, D_MAX = 3, 8
GRID = (
    Detector("Q_coherent_band", "coherent"),
    Detector("Q_adjacency_band", "time_avg", "adjacency"),
    Detector("Q_coherent_multi", "coherent", scales=((None, {"scale": 0.5}), (None, {"scale": 1.0}), (None, {"scale": 2.0}), (None, {"scale": 4.0}))),
    Detector("Q_communic_band", "q_communicability", "adjacency", params={"beta": 0.5}),
    Detector("C_communic_band", "communicability", "adjacency", params={"beta": 0.15}),
    Detector("Q_communic_multi", "q_communicability", "adjacency", scales=((None, {"beta": 0.25}), (None, {"beta": 0.5}), (None, {"beta": 1.0}), (None, {"beta": 2.0}))),
    Detector("A_qcommunic_zabs", "q_communicability", "adjacency", ranking="zabs", params={"beta": 0.5}),
    Detector("A_gnm_zabs", "gnm", ranking="zabs"),
    Detector("C_yukawa_band", "yukawa", params={"m2": 0.5}),
    Detector("LST_interference", "interference"),
    Detector("LST_logf_coherent", "coherent", "logf", 1.0),
    Detector("LST_logf_interf", "interference", "logf", 1.0),
    Detector("LST_interf_multi", "interference", "logf", scales=((0.5, {}), (1.0, {}), (2.0, {}))),
    Detector("C_classical_band", "classical"),
    Detector("C_gnm_zscore", "gnm", ranking="zscore"),
    Detector("C_resistance_prox", "resistance", ranking="none"),
    Detector("A_active_proximal", "time_avg", ranking="none"),
    Detector("A_active_zabs", "time_avg", ranking="zabs"),
    Detector("A_active_zscore", "time_avg", ranking="zscore"),
)
CONSENSUS = ("LST_logf_interf", "LST_logf_coherent", "A_active_zabs", "Q_communic_band")
#: Channels that are left out, and those that hold phases.
BALLAST = ("coherent", "communic", "interf_T40")
PHASE = ("interf_T10", "interf_T20", "quadrature", "phase_coh", "gauge_coh", "gauge_interf")
#: Hit-list variants: the detector of the first, and the pool of the adaptive one.
PRECISION = "Q_communic_band"
POOL, ACTIVE_POOL = ("LST_logf_interf", "LST_logf_coherent"), ("A_active_zabs", "A_gnm_zabs")


def curated(channels: list[str]) -> list[str]:
    return [c for c in channels if c not in BALLAST]


def amplitude(channels: list[str]) -> list[str]:
    """Curated channels that hold no phase."""
    return [c for c in curated(channels) if c not in PHASE]


def merged(base: dict, over: dict) -> dict:
    """base with the values of `over`, inner dictionaries value by value."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_settings(path: str) -> dict:
    """Settings or targets from a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _matrix(s: spectral.Structure, d: Detector, value, params: dict) -> np.ndarray:
    if "scale" in params:
        params = {"t": params["scale"] * spectral.typical_time(s.eig(d.kind, value)[0])}
    return spectral.metric_matrix(s, d.metric, d.kind, value, **params)


def _active(s: spectral.Structure, m: np.ndarray, how: str) -> np.ndarray:
    a = s.nodes["is_active"].to_numpy(bool)
    raw = m[:, a].sum(1)
    if how == "none" or not a.any():
        return raw
    if how == "distance":
        return (m[:, a] * np.maximum(0, s.hops[:, a])).sum(1)
    shell, z = s.hops[:, a].min(1), np.zeros(s.n)
    for k in np.unique(shell[shell >= 0]):  # -1: some active node cannot be reached
        own = shell == k
        spread = raw[own].std()
        if spread**2 > 1e-12:
            z[own] = (raw[own] - raw[own].mean()) / spread
    return np.abs(z) if how == "zabs" else z


def _score(s: spectral.Structure, d: Detector) -> np.ndarray:
    def one(value, params):
        m = _matrix(s, d, value, params)
        return s.band(m, D_MIN, D_MAX) if d.ranking == "band" else _active(s, m, d.ranking)

    if not d.scales:
        return one(d.value, d.params)
    places = [np.argsort(np.argsort(-significant_array(one(v, p)), kind="stable")) for v, p in d.scales]
    return -np.mean(places, axis=0)


def detector_scores(nodes: DataFrame, edges: DataFrame, grid: tuple[Detector, ...] = GRID) -> DataFrame:
    """(structure_id, detector, node_id, score)"""

    def run(s: spectral.Structure) -> dict:
        return {"detector": [d.name for d in grid for _ in s.ids], "node_id": np.tile(s.ids, len(grid)), "score": np.concatenate([_score(s, d) for d in grid])}

    return spectral.per_structure(nodes, edges, run, "detector string, node_id long, score double")


def orders(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds pos within each structure and detector; active nodes are left out."""
    both = F.concat_ws("\x1f", S, "detector")
    keyed = scores.select(both.alias(S), "node_id", "score")
    names = scores.select("detector").distinct()
    active = nodes.filter("is_active").select(S, "node_id").crossJoin(F.broadcast(names)).select(both.alias(S), "node_id")
    part = F.split(S, "\x1f")
    return ranking.finalize(keyed, active).select(part[0].alias(S), part[1].alias("detector"), "node_id", "score", "pos")


def leaderboard(nodes: DataFrame, edges: DataFrame, grid: tuple[Detector, ...] = GRID) -> DataFrame:
    """(structure_id, exp, roc_auc, mwu z, hits...) for every detector, consensus modes among them."""
    # Used for every consensus mode and for scoring: the eigensystems are made once.
    ranked = cut_lineage(orders(detector_scores(nodes, edges, grid), nodes))
    members = ranked.filter(F.col("detector").isin(*CONSENSUS))
    for mode in ("min", "median", "rrf"):
        fused = ranking.consensus(members, nodes, mode).withColumn("detector", F.lit(f"consensus_{mode}"))
        ranked = ranked.unionByName(orders(fused, nodes))
    x = ranked.join(nodes.select(S, "node_id", "y01"), [S, "node_id"])
    stats = scoring.rank_statistics(x, "detector").select(S, F.col("detector").alias("exp"), F.round("auc", 4).alias("roc_auc"), F.round("z", 4).alias("z"))
    top = scoring.hits(x.withColumn(S, F.concat_ws("\x1f", S, "detector")), (5, 10, 20))
    part = F.split(S, "\x1f")
    top = top.select(part[0].alias(S), part[1].alias("exp"), *[c for c in top.columns if c != S])
    return stats.join(top, [S, "exp"])


def submission(nodes: DataFrame, edges: DataFrame, lean: int = 20, trees: int = 200) -> DataFrame:
    """(structure_id, node_id, detector, regime, routed, boosted, fused, pos): the routed detector and boosted trees of every structure.

    A structure's trees learn from the other folds, on the channels that transfer best there; the fused score is the sum
    of both scores' rank percentages.
    """
    routed_scores = cut_lineage(detector_scores(nodes, edges, tuple(d for d in GRID if d.name in CONSENSUS)))
    routed = routed_scores.join(ranking.route(routed_scores), [S, "detector"])
    cols = curated(features.channel_names("bank23"))
    bank = features.zscore(features.feature_bank(nodes, edges, "bank23"), cols).join(nodes.select(S, "node_id", "y01"), [S, "node_id"])
    bank = cut_lineage(bank.select(S, "node_id", "y01", *[f"`{c}`" for c in cols]))
    boosted = cut_lineage(learned.boosted_transfer(bank, cols, trees, lean))
    fused = ranking.fuse_percent(routed.select(S, "node_id", "score"), boosted.select(S, "node_id", "score"))
    ranked = ranking.finalize(fused, nodes.filter("is_active"))
    out = ranked.withColumnRenamed("score", "fused").join(routed.select(S, "node_id", "detector", "regime", F.col("score").alias("routed")), [S, "node_id"])
    return out.join(boosted.select(S, "node_id", F.col("score").alias("boosted")), [S, "node_id"])


def predict_variants(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(structure_id, variant, pos, node_id, score): hit lists by precision, of the most decisive of the pool, and of the
    consensus by best and by reciprocal ranks."""
    wanted = {PRECISION, *POOL, *ACTIVE_POOL, *CONSENSUS}
    ranked = cut_lineage(orders(detector_scores(nodes, edges, tuple(d for d in GRID if d.name in wanted)), nodes))
    lists = {"precision": ranked.filter(F.col("detector") == PRECISION)}
    best = ranking.adaptive(ranked.select(S, "detector", "node_id", "score"), nodes, POOL, ACTIVE_POOL)
    lists["adaptive"] = ranked.join(best.select(S, "detector"), [S, "detector"], "left_semi")
    members = ranked.filter(F.col("detector").isin(*CONSENSUS))
    for mode, name in (("min", "consensus"), ("rrf", "consensus_rrf")):
        lists[name] = orders(ranking.consensus(members, nodes, mode).withColumn("detector", F.lit(name)), nodes)
    out = None
    for name, rows in lists.items():
        one = rows.filter(F.col("pos") <= top).select(S, F.lit(name).alias("variant"), "pos", "node_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def low_modes(w: np.ndarray, k: int = 6) -> np.ndarray:
    """The first k non-zero eigenvalues, in units of the first."""
    w = w[w > spectral.TINY][:k]
    return w / w[0] if len(w) else w


def preservation(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, k: int = 6, rolled: DataFrame | None = None) -> DataFrame:
    """(structure_id, mean_error): relative error of the coarse graph's low eigenvalues; null where one has none. `rolled` is
    the clusters' `cluster_rollup`, if it was made before."""

    def run(key: tuple, fine: pd.DataFrame, coarse: pd.DataFrame) -> pd.DataFrame:
        def laplacian(i, j, v, n):
            m = np.zeros((n, n))
            m[i, j] = v
            return np.diag(m.sum(1)) - m

        ids, at = np.unique(np.concatenate([fine["i"], fine["j"]]), return_inverse=True)
        own, of = np.unique(np.concatenate([coarse["a"], coarse["b"]]), return_inverse=True)
        f = low_modes(np.linalg.eigvalsh(laplacian(at[: len(fine)], at[len(fine) :], 1.0, len(ids))), k) if len(ids) else np.zeros(0)
        c = low_modes(np.linalg.eigvalsh(laplacian(of[: len(coarse)], of[len(coarse) :], coarse["contacts"].to_numpy(float), len(own))), k) if len(own) else np.zeros(0)
        m = min(len(f), len(c))
        return pd.DataFrame({S: key[0], "mean_error": [float(np.mean(np.abs(c[:m] - f[:m]) / (f[:m] + 1e-9))) if m else None]})

    rolled = (graph.cluster_rollup(edges, clusters) if rolled is None else rolled).select(F.col(S).alias("_of"), "a", "b", "contacts")
    return edges.groupBy(S).cogroup(rolled.groupBy("_of")).applyInPandas(run, f"{S} string, mean_error double")


def _detector_auc(nodes: DataFrame, edges: DataFrame, d_min: int) -> DataFrame:
    """(structure_id, node_id, score) of the interference detector, and its AUC by structure."""
    return spectral.band_scores(nodes, edges, "interference", "logf", 1.0, d_min)


def retention(nodes: DataFrame, edges: DataFrame, cluster, ratios: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """(structure_id, ratio, clusters, auc_full, auc_super, auc_nodes, retention, mean_error, cheaper).

    `cluster(nodes, edges, ratio)` gives (structure_id, node_id, cluster_id). A cluster is positive if it holds a positive node.
    """
    labels, edges = nodes.select(S, "node_id", "y01"), cut_lineage(edges)
    full = scoring.roc_auc(_detector_auc(nodes, edges, 3).join(labels, [S, "node_id"])).select(S, F.col("auc").alias("auc_full"))
    size = nodes.groupBy(S).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for ratio in ratios:
        c = cut_lineage(cluster(nodes, edges, ratio))
        super_nodes = graph.cluster_labels(labels, c).select(S, F.col("cluster_id").alias("node_id"), "y01", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
        rolled = cut_lineage(graph.cluster_rollup(edges, c))
        links = rolled.select(S, F.col("a").alias("i"), F.col("b").alias("j"))
        scores = cut_lineage(_detector_auc(super_nodes, links, 1))
        coarse = scoring.roc_auc(scores.join(super_nodes.select(S, "node_id", "y01"), [S, "node_id"])).select(S, F.col("auc").alias("auc_super"))
        down = graph.cluster_project(scores.select(S, F.col("node_id").alias("cluster_id"), "score"), c)
        fine = scoring.roc_auc(down.join(labels, [S, "node_id"])).select(S, F.col("auc").alias("auc_nodes"))
        m = c.groupBy(S).agg(F.countDistinct("cluster_id").alias("clusters"))
        one = full.join(coarse, S).join(fine, S).join(preservation(nodes, edges, c, rolled=rolled), S).join(m, S).join(size, S)
        kept = F.col("auc_nodes") / F.greatest(F.col("auc_full"), F.lit(1e-9))
        one = one.select(S, F.lit(ratio).alias("ratio"), "clusters", *[F.round(x, 4).alias(x) for x in ("auc_full", "auc_super", "auc_nodes")], F.round(kept, 4).alias("retention"), F.round("mean_error", 4).alias("mean_error"), F.round(F.pow(F.col("n") / F.col("clusters"), 3), 0).alias("cheaper"))
        out = one if out is None else out.unionByName(one)
    return out


def jitter(nodes: DataFrame, cutoff: float = 8.0, widths: tuple[float, ...] = (0.5, 1.0, 1.5), draws: int = 8) -> DataFrame:
    """(structure_id, sigma, mean_auc, std_auc): the interference detector on graphs of coordinates with normal noise."""
    many = nodes.withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in widths]))).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    def drawn(axis: str):
        u = lambda k: scoring.uniform(F.col("node_id"), F.col("sigma"), F.col("rep"), F.lit(axis + k))
        return F.col(axis) + F.col("sigma") * F.sqrt(-2.0 * F.log(u("a"))) * F.cos(2 * np.pi * u("b"))

    key = F.concat_ws("\x1f", S, F.col("sigma").cast("string"), F.col("rep").cast("string")).alias(S)
    moved = cut_lineage(many.select(key, "node_id", "y01", *[drawn(c).alias(c) for c in "xyz"]))
    score = lambda s: s.band(spectral.interference(*s.eig("logf", 1.0)), 3)
    scores = spectral.per_cloud(moved, cutoff, lambda s: {"node_id": s.ids, "y01": s.nodes["y01"], "score": score(s)}, "node_id long, y01 int, score double")
    auc = scoring.roc_auc(cut_lineage(scores))
    part = F.split(S, "\x1f")
    return auc.groupBy(part[0].alias(S), part[1].cast("double").alias("sigma")).agg(F.round(F.avg("auc"), 4).alias("mean_auc"), F.round(F.stddev_pop("auc"), 4).alias("std_auc"))
