"""Scores to orders: bands, active sites, fusion and routing. Scores are (structure_id, node_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import significant
from .graph import S


def finalize(scores: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Adds `pos`: 1 is best, ties (of nine digits) go to the smaller id; null for excluded nodes and scores that are not finite."""
    x = scores.withColumn("_out", F.lit(False)) if excluded is None else scores.join(excluded.select(S, "node_id").distinct().withColumn("_e", F.lit(True)), [S, "node_id"], "left").withColumn("_out", F.coalesce("_e", F.lit(False))).drop("_e")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    x = x.withColumn("_out", F.col("_out") | ~F.coalesce(finite, F.lit(False)))
    order = Window.partitionBy(S, "_out").orderBy(significant(F.col("score")).desc(), "node_id")
    return x.withColumn("pos", F.when(~F.col("_out"), F.row_number().over(order))).drop("_out")


def hit_list(ranked: DataFrame, nodes: DataFrame, top: int = 5) -> DataFrame:
    return ranked.filter(F.col("pos") <= top).join(nodes.drop("score"), [S, "node_id"])


def band_score(matrix: DataFrame, gdist: DataFrame, nodes: DataFrame, d_min: int = 3, d_max: int | None = None) -> DataFrame:
    """Sum of a matrix (structure_id, i, j, v) over the pairs from d_min (to d_max) hops apart."""
    band = gdist.filter((F.col("d") >= d_min) & (F.col("d") <= (d_max if d_max is not None else 1 << 30))).select(S, "i", "j")
    s = matrix.filter("i <> j").join(band, [S, "i", "j"]).groupBy(S, F.col("i").alias("node_id")).agg(F.sum("v").alias("score"))
    return nodes.select(S, "node_id").join(s, [S, "node_id"], "left").na.fill(0.0, ["score"])


def active_score(matrix: DataFrame, gdist: DataFrame | None, nodes: DataFrame, normalize: str = "zscore", shells: DataFrame | None = None) -> DataFrame:
    """Connectivity of every node to the active ones: raw ("none"), by shells ("zscore", "zabs") or times hops ("distance").

    Raw scores need no hop counts; `shells` (structure_id, node_id, d), as of `graph.active_shells`, stand for those of shells.
    """
    if normalize not in ("none", "zscore", "zabs", "distance"):
        raise ValueError(f"unknown normalisation {normalize!r}")
    active = nodes.filter("is_active").select(S, F.col("node_id").alias("j"))
    to = matrix.join(active, [S, "j"])
    base = nodes.select(S, "node_id")
    near = None if gdist is None else gdist.join(active, [S, "j"])
    if normalize == "distance":
        s = to.join(near.select(S, "i", "j", "d"), [S, "i", "j"]).groupBy(S, F.col("i").alias("node_id")).agg(F.sum(F.col("v") * F.col("d")).alias("score"))
        return base.join(s, [S, "node_id"], "left").na.fill(0.0, ["score"])
    raw = base.join(to.groupBy(S, F.col("i").alias("node_id")).agg(F.sum("v").alias("score")), [S, "node_id"], "left").na.fill(0.0, ["score"])
    if normalize == "none":
        return raw
    # A node that cannot reach every active one is in no shell.
    if shells is not None:
        return _by_shell(raw.join(shells, [S, "node_id"], "left"), normalize)
    n_active = active.groupBy(S).agg(F.count(F.lit(1)).alias("n"))
    reach = near.groupBy(S, F.col("i").alias("node_id")).agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("k"))
    shell = reach.join(n_active, S).filter("k = n").select(S, "node_id", "d")
    return _by_shell(raw.join(shell, [S, "node_id"], "left"), normalize)


def _by_shell(x: DataFrame, normalize: str) -> DataFrame:
    """Scores (structure_id, node_id, score, d) against the mean and spread of their shell."""
    w = Window.partitionBy(S, "d")
    mean, var = F.avg("score").over(w), F.avg(F.col("score") * F.col("score")).over(w)
    x = x.withColumn("_m", mean).withColumn("_v", var - F.col("_m") * F.col("_m"))
    z = F.when(F.col("d").isNotNull() & (F.col("_v") > 1e-12), (F.col("score") - F.col("_m")) / F.sqrt("_v")).otherwise(0.0)
    return x.select(S, "node_id", (F.abs(z) if normalize == "zabs" else z).alias("score"))


def consensus(ranked: DataFrame, nodes: DataFrame, mode: str = "mean") -> DataFrame:
    """Fuse detectors' orders (structure_id, detector, node_id, pos): min, median, mean (Borda) or rrf.

    Ranks count from 0, and a node that a detector leaves out has rank n.
    """
    detectors = ranked.select(S, "detector").distinct()
    size = nodes.groupBy(S).agg(F.count(F.lit(1)).alias("n"))
    every = nodes.select(S, "node_id").join(detectors, S).join(size, S)
    r = every.join(ranked.select(S, "detector", "node_id", "pos"), [S, "detector", "node_id"], "left").withColumn("r", F.coalesce(F.col("pos") - 1, F.col("n")).cast("double"))
    how = {"min": -F.min("r"), "mean": -F.avg("r"), "median": -F.percentile("r", 0.5), "rrf": F.sum(1.0 / (60.0 + F.col("r")))}
    if mode not in how:
        raise ValueError(f"unknown fusion {mode!r}")
    return r.groupBy(S, "node_id").agg(how[mode].alias("score"))


def decisiveness(scores: DataFrame, *by: str) -> DataFrame:
    """Kurtosis of finite scores, 0 for fewer than four or without spread."""
    x = scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    k = F.when((F.count("score") < 4) | (F.stddev_pop("score") < 1e-12), 0.0).otherwise(F.kurtosis("score") + 3.0)
    return x.groupBy(S, *by).agg(k.alias("decisiveness"))


def route(scores: DataFrame) -> DataFrame:
    """The detector with the most decisive scores of each structure, and its regime."""
    d = decisiveness(scores, "detector")
    order = Window.partitionBy(S).orderBy(significant(F.col("decisiveness")).desc(), "detector")
    best = d.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    return best.withColumn("regime", F.when(F.col("detector").startswith("gnm") | F.contains("detector", F.lit("active")), "proximal").otherwise("distal"))


def rank_percent(values: DataFrame, col: str, *by: str) -> DataFrame:
    """(row number - 1) / (n - 1) in ascending order, ties by id."""
    w, o = Window.partitionBy(S, *by), Window.partitionBy(S, *by).orderBy(significant(F.col(col)), "node_id")
    return values.withColumn(f"{col}_pct", (F.row_number().over(o) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1))


def fuse_percent(a: DataFrame, b: DataFrame) -> DataFrame:
    x = rank_percent(a.select(S, "node_id", F.col("score").alias("sa")), "sa").join(rank_percent(b.select(S, "node_id", F.col("score").alias("sb")), "sb"), [S, "node_id"])
    return x.select(S, "node_id", (F.col("sa_pct") + F.col("sb_pct")).alias("score"))


def blend(scores: list[DataFrame]) -> DataFrame:
    """(structure_id, node_id, score): the mean of several scores' rank percentages."""
    out = None
    for k, x in enumerate(scores):
        one = rank_percent(x.select(S, "node_id", F.col("score").alias(f"s{k}")), f"s{k}").select(S, "node_id", f"s{k}_pct")
        out = one if out is None else out.join(one, [S, "node_id"])
    return out.select(S, "node_id", (sum((F.col(f"s{k}_pct") for k in range(len(scores))), F.lit(0.0)) / len(scores)).alias("score"))


def adaptive(scores: DataFrame, nodes: DataFrame, always: tuple[str, ...], with_active: tuple[str, ...]) -> DataFrame:
    """(structure_id, detector, decisiveness): the most decisive of a pool of detectors (ties by name); the second part of
    the pool is open to structures with active nodes only."""
    has = nodes.filter("is_active").select(S).distinct().withColumn("_has", F.lit(True))
    open_ = scores.join(has, S, "left").filter(F.col("detector").isin(*always) | (F.col("_has") & F.col("detector").isin(*with_active))).drop("_has")
    return route(open_).select(S, "detector", "decisiveness")
