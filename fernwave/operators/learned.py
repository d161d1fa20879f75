"""Models on channel tables: sums over rows are distributed, the small systems that they lead to are solved at the end.

A table is (structure_id, node_id, y01, channels...). Folds leave one structure out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import significant
from ..functions.lineage import cut_lineage
from . import boosting
from .graph import S
from .ranking import blend
from .scoring import pooled_auc, rank_statistics

QUANTILES = (0.35, 0.5, 0.65)


def quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def gram(x: DataFrame, cols: list[str], y: str = "y01") -> DataFrame:
    """(a, b, v): sums of products of channels (a <= b in their order), and (a, "label", v): with the centred label.

    One pass: tasks sum the products of ones, labels and channels over their rows, and each sends one row a product.
    """

    def run(batches):
        g = np.zeros((len(cols) + 2, len(cols) + 2))
        for pdf in batches:
            u = np.column_stack([np.ones(len(pdf)), pdf.to_numpy(float)])
            g += u.T @ u
        a, b = np.triu_indices(len(g))
        yield pd.DataFrame({"i": a, "j": b, "v": g[a, b]})

    sums = cut_lineage(x.select(F.col(y).cast("double"), *[quoted(c).cast("double") for c in cols]).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")))
    ones = F.broadcast(sums.filter("i = 0 AND j > 1").select(F.col("j").alias("_k"), F.col("v").alias("_sum")))  # a row for each channel
    mean = F.broadcast(sums.agg((F.max(F.when(F.expr("i = 0 AND j = 1"), F.col("v"))) / F.greatest(F.lit(1.0), F.max(F.when(F.expr("i = 0 AND j = 0"), F.col("v"))))).alias("_mean")))
    names = F.array(*[F.lit(c) for c in cols])
    pairs = sums.filter("i > 1").select(F.get(names, F.col("i") - 2).alias("a"), F.get(names, F.col("j") - 2).alias("b"), "v")
    labels = sums.filter("i = 1 AND j > 1").join(ones, F.col("j") == F.col("_k")).crossJoin(mean)
    return pairs.unionByName(labels.select(F.get(names, F.col("j") - 2).alias("a"), F.lit("label").alias("b"), (F.col("v") - F.col("_mean") * F.col("_sum")).alias("v")))


def solve(gram_rows: list, cols: list[str], ridge: float) -> np.ndarray:
    at = {c: k for k, c in enumerate(cols)}
    g, b = np.zeros((len(cols), len(cols))), np.zeros(len(cols))
    for r in gram_rows:
        if r["b"] == "label":
            b[at[r["a"]]] = r["v"]
        else:
            g[at[r["a"]], at[r["b"]]] = g[at[r["b"]], at[r["a"]]] = r["v"]
    return np.linalg.solve(g + ridge * np.eye(len(cols)), b)


def ridge(x: DataFrame, cols: list[str], penalty: float = 1.0) -> dict[str, float]:
    """Coefficients of centred labels on channels; only the d x d sums reach the driver."""
    return dict(zip(cols, solve(gram(x, cols).collect(), cols, penalty).tolist(), strict=True))


def structure_sums(x: DataFrame, cols: list[str]) -> DataFrame:
    """(structure_id, a, b, v): each structure's sums of products of ones (0), labels (1) and channels (2, 3, ...), a <= b."""

    def run(key, pdf):
        u = np.column_stack([np.ones(len(pdf)), pdf.drop(columns=S).to_numpy(float)])
        g = u.T @ u
        a, b = np.triu_indices(len(g))
        return pd.DataFrame({S: key[0], "a": a, "b": b, "v": g[a, b]})

    named = [quoted(c).alias(f"c{k}") for k, c in enumerate(cols)]
    return x.select(S, "y01", *named).groupBy(S).applyInPandas(run, f"{S} string, a int, b int, v double")


def solved(sums: DataFrame, n_cols: int, penalty: float) -> DataFrame:
    """(structure_id, c): ridge coefficients of centred labels from sums like those of `structure_sums`."""

    def run(key, pdf):
        g = np.zeros((n_cols + 2, n_cols + 2))
        g[pdf["a"], pdf["b"]] = g[pdf["b"], pdf["a"]] = pdf["v"]
        moment = g[1, 2:] - g[0, 1] / max(g[0, 0], 1.0) * g[0, 2:]
        return pd.DataFrame({S: [key[0]], "c": [np.linalg.solve(g[2:, 2:] + penalty * np.eye(n_cols), moment).tolist()]})

    return sums.groupBy(S).applyInPandas(run, f"{S} string, c array<double>")


def sparse_solved(sums: DataFrame, n_cols: int, threshold: float = 0.05, penalty: float = 1.0, rounds: int = 10) -> DataFrame:
    """(structure_id, c): as `solved`, refitted to the channels whose coefficients stay above a threshold; 0 for the others."""

    def run(key, pdf):
        g = np.zeros((n_cols + 2, n_cols + 2))
        g[pdf["a"], pdf["b"]] = g[pdf["b"], pdf["a"]] = pdf["v"]
        moment = g[1, 2:] - g[0, 1] / max(g[0, 0], 1.0) * g[0, 2:]
        m, c = g[2:, 2:] + penalty * np.eye(n_cols), np.zeros(n_cols)
        left = np.arange(n_cols)
        c[left] = np.linalg.solve(m, moment)
        for _ in range(rounds):
            left = left[np.abs(c[left]) >= threshold]
            c[:] = 0.0
            if not len(left):
                break
            c[left] = np.linalg.solve(m[np.ix_(left, left)], moment[left])
        return pd.DataFrame({S: [key[0]], "c": [c.tolist()]})

    return sums.groupBy(S).applyInPandas(run, f"{S} string, c array<double>")


def others(sums: DataFrame) -> DataFrame:
    """Sums over all structures but each one: the total less its own."""
    total = sums.groupBy("a", "b").agg(F.sum("v").alias("all"))
    return sums.join(F.broadcast(total), ["a", "b"]).select(S, "a", "b", (F.col("all") - F.col("v")).alias("v"))  # a row for each pair of channels


def applied(x: DataFrame, cols: list[str], fitted: DataFrame) -> DataFrame:
    """(structure_id, node_id, y01, score): channels times their structure's coefficients."""
    score = sum((quoted(c) * F.col("c")[k] for k, c in enumerate(cols)), F.lit(0.0))
    return x.join(fitted, S).select(S, "node_id", "y01", score.alias("score"))


def ridge_transfer(x: DataFrame, cols: list[str], penalty: float = 1.0) -> DataFrame:
    """(structure_id, node_id, y01, score): each structure scored by a ridge model of all the others. Only sums are moved."""
    return applied(x, cols, solved(others(structure_sums(x, cols)), len(cols), penalty))


def operator_fits(x: DataFrame, cols: list[str], penalty: float = 1.0) -> DataFrame:
    """(structure_id, c): each structure's own ridge operator."""
    return solved(structure_sums(x, cols), len(cols), penalty)


def operator_agreement(fits: DataFrame) -> DataFrame:
    """(structure_id, other, cosine) for pairs of structures' operators, the smaller name first."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
    unit = fits.select(S, F.transform("c", lambda v: v / (norm(F.col("c")) + 1e-12)).alias("u"))
    other = unit.select(F.col(S).alias("other"), F.col("u").alias("w"))
    dot = F.aggregate(F.zip_with("u", "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return unit.join(other, F.col(S) < F.col("other")).select(S, "other", dot.alias("cosine"))


def most_divergent(fits: DataFrame, cols: list[str], top: int = 5) -> DataFrame:
    """(structure_id, other, cosine, channel, gap): the pair that agrees least (ties by name), and the channels that part it most."""
    pair = operator_agreement(fits).orderBy("cosine", S, "other").limit(1)
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, v: a + v * v)) + 1e-9
    unit = fits.select(F.col(S).alias("_s"), F.transform("c", lambda v: v / norm).alias("u"))
    both = pair.join(unit, F.col(S) == F.col("_s")).select(S, "other", "cosine", "u").join(unit.select(F.col("_s").alias("_o"), F.col("u").alias("w")), F.col("other") == F.col("_o"))
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.abs(F.col("u")[k] - F.col("w")[k]).alias("gap")) for k, c in enumerate(cols)])
    return both.select(S, "other", "cosine", F.explode(rows).alias("r")).select(S, "other", "cosine", "r.*").orderBy(F.desc("gap"), "channel").limit(top)


def linear(coefficients: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for c, v in coefficients.items():
        out = out + quoted(c) * F.lit(v)
    return out


def sparse_law(x: DataFrame, cols: list[str], threshold: float = 0.05, penalty: float = 1.0, rounds: int = 10) -> dict[str, float]:
    """Ridge refitted to the terms that stay above a threshold, from one set of sums."""
    rows, left = gram(x, cols).collect(), list(cols)
    c = dict(zip(left, solve(rows, left, penalty), strict=True))
    for _ in range(rounds):
        left = [k for k in left if abs(c[k]) >= threshold]
        if not left:
            break
        keep = set(left)
        c = dict(zip(left, solve([r for r in rows if r["a"] in keep and (r["b"] in keep or r["b"] == "label")], left, penalty), strict=True))
    return {k: float(c[k]) if k in left else 0.0 for k in cols}


def formula(c: dict[str, float], top: int = 6) -> str:
    terms = sorted(((k, v) for k, v in c.items() if abs(v) >= 1e-6), key=lambda t: -abs(t[1]))
    return " ".join(f"{v:+.3f}*{k}" for k, v in terms[:top])


def long_channels(x: DataFrame, cols: list[str]) -> DataFrame:
    """(structure_id, node_id, y01, channel, score)"""
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), quoted(c).alias("score")) for c in cols])
    return x.select(S, "node_id", "y01", F.explode(rows).alias("r")).select(S, "node_id", "y01", "r.channel", "r.score")


def channel_auc(x: DataFrame, cols: list[str]) -> DataFrame:
    """(structure_id, channel, auc) of every channel on its own."""
    return rank_statistics(long_channels(x, cols), "channel").select(S, "channel", "auc")


def best_channel(auc: DataFrame) -> DataFrame:
    """For each structure, the channel that is best on average elsewhere, with either sign; ties by name."""
    folds = auc.select(F.col(S).alias("fold")).distinct()
    train = auc.join(folds, F.col(S) != F.col("fold")).groupBy("fold", "channel").agg(F.avg("auc").alias("m"))
    scored = train.withColumn("strength", F.greatest("m", 1 - F.col("m"))).withColumn("sign", F.when(F.col("m") >= 0.5, 1).otherwise(-1))
    first = Window.partitionBy("fold").orderBy(F.desc("strength"), "channel")
    return scored.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(F.col("fold").alias(S), "channel", "sign", "strength")


def lean_top(auc: DataFrame, k: int = 20) -> DataFrame:
    """The k channels with the best mean of max(auc, 1 - auc) over structures."""
    m = auc.groupBy("channel").agg(F.avg(F.greatest("auc", 1 - F.col("auc"))).alias("strength"))
    return m.orderBy(F.desc("strength"), "channel").limit(k)


def lean_folds(auc: DataFrame, k: int = 20) -> DataFrame:
    """(fold, channels): what `lean_top` picks from the structures of all other folds (auc has a column fold); a fold's own sums
    are taken from those of all."""
    strength = F.greatest("auc", 1 - F.col("auc"))
    own = auc.groupBy("fold", "channel").agg(F.coalesce(F.sum(strength), F.lit(0.0)).alias("s"), F.count(strength).alias("n"))
    every = own.groupBy("channel").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    left = F.when(F.col("all_n") > F.col("n"), (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")))
    rest = own.join(F.broadcast(every), "channel").withColumn("strength", significant(left))  # a row for each channel
    best = rest.withColumn("_r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("strength"), "channel"))).filter(F.col("_r") <= k)
    return best.groupBy("fold").agg(F.array_sort(F.collect_list("channel")).alias("channels"))


def transfer_audit(auc: DataFrame) -> DataFrame:
    """(structure_id, channel, transfer): AUC on the structure left out, with the sign that the others suggest."""
    folds = auc.select(F.col(S).alias("fold")).distinct()
    sign = auc.join(folds, F.col(S) != F.col("fold")).groupBy("fold", "channel").agg((F.avg("auc") >= 0.5).alias("up"))
    own = auc.select(F.col(S).alias("fold"), "channel", "auc")
    return own.join(sign, ["fold", "channel"]).select(F.col("fold").alias(S), "channel", F.when(F.col("up"), F.col("auc")).otherwise(1 - F.col("auc")).alias("transfer"))


def type_means(transfer: DataFrame, types: DataFrame) -> DataFrame:
    """(type, transfer, channels): the mean over a type's channels (channel, type) of their mean over structures."""
    per = transfer.groupBy("channel").agg(F.avg("transfer").alias("m")).join(types, "channel", "left")
    return per.groupBy(F.coalesce("type", F.lit("?")).alias("type")).agg(F.avg("m").alias("transfer"), F.count(F.lit(1)).alias("channels"))


def stumps(x: DataFrame, cols: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(k, channel, threshold, sign): thresholds at exact quantiles, with both signs."""
    one = x.agg(*[F.percentile(quoted(c), F.array(*[F.lit(q) for q in quantiles])).alias(c) for c in cols])
    rows = [F.struct(F.lit((k * len(quantiles) + q) * 2 + s).alias("k"), F.lit(c).alias("channel"), quoted(c)[q].alias("threshold"), F.lit(1 - 2 * s).alias("sign")) for k, c in enumerate(cols) for q in range(len(quantiles)) for s in (0, 1)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def votes(x: DataFrame, cols: list[str], pool: DataFrame) -> DataFrame:
    """(structure_id, node_id, y01, k, h): every stump's vote on every row; the pool is a few hundred rows."""
    return long_channels(x, cols).join(F.broadcast(pool), "channel").select(S, "node_id", "y01", "k", (F.col("sign") * F.when(F.col("score") >= F.col("threshold"), 1.0).otherwise(-1.0)).alias("h"))


def qubo(x: DataFrame, cols: list[str], pool: DataFrame, penalty: float = 0.04) -> DataFrame:
    """(a, b, q) for all a, b: quadratic form of choosing stumps, with labels -1 and 1.

    The pool is a few hundred rows. Tasks sum the products of all votes over their rows; a task sends K * K sums.
    """
    stumps_ = pool.select("k", "channel", "threshold", "sign").toPandas().sort_values("k")
    k, of = stumps_["k"].to_numpy(), [cols.index(c) for c in stumps_["channel"]]
    threshold, sign, n = stumps_["threshold"].to_numpy(float), stumps_["sign"].to_numpy(float), len(stumps_)

    def run(batches):
        g = np.zeros((n + 1, n))
        for pdf in batches:
            h = np.where(pdf[cols].to_numpy(float)[:, of] >= threshold, sign, -sign)
            g[:n] += h.T @ h
            g[n] += h.T @ (2.0 * pdf["y01"].to_numpy(float) - 1.0)
        a, b = np.divmod(np.arange(n * n), n)
        yield pd.DataFrame({"a": k[a], "b": k[b], "hh": g[:n].ravel(), "hy": g[n][a]})

    sums = x.select("y01", *[quoted(c) for c in cols]).mapInPandas(run, "a int, b int, hh double, hy double").groupBy("a", "b").agg(F.sum("hh").alias("hh"), F.sum("hy").alias("hy"))
    diagonal = F.col("hh") / float(n * n) - 2.0 / n * F.col("hy") + penalty
    return sums.select("a", "b", F.when(F.col("a") == F.col("b"), diagonal).otherwise(2.0 / (n * n) * F.col("hh")).alias("q"))


def anneal(q: DataFrame, restarts: int = 8, steps: int = 4000, seed: int = 0) -> DataFrame:
    """(restart, energy, chosen): one simulated annealing run a row; the least energy wins with min_by."""
    n = q.agg((F.max("a") + 1).alias("n")).first().n or 0  # a few hundred at most
    packed = q.groupBy().agg(F.collect_list(F.struct("a", "b", "q")).alias("m"))
    runs = q.sparkSession.range(restarts).withColumnRenamed("id", "restart").crossJoin(F.broadcast(packed))

    def run(batches):
        for pdf in batches:
            for restart, m in zip(pdf["restart"], pdf["m"], strict=True):
                g = np.random.default_rng([seed, int(restart)])
                mat = np.zeros((n, n))
                for r in m:
                    mat[r["a"], r["b"]] = r["q"]
                unit = float(np.abs(mat).max(initial=0.0)) or 1.0  # energies grow with the rows, and temperatures with them
                w = g.integers(0, 2, n).astype(float)
                field, energy = mat @ w, float(w @ mat @ w)
                best, least = w.copy(), energy
                for t, (i, u) in enumerate(zip(g.integers(0, n, steps), g.random(steps), strict=True)):
                    flip = 1 - 2 * w[i]
                    de = flip * (mat[i, i] + 2 * (field[i] - mat[i, i] * w[i]))
                    if de < 0 or u < np.exp(-de / (unit * max(1e-3, 1 - t / steps))):
                        w[i] += flip
                        field += flip * mat[:, i]
                        energy += de
                        if energy < least:
                            best, least = w.copy(), energy
                yield pd.DataFrame({"restart": [restart], "energy": [least], "chosen": [np.flatnonzero(best).tolist()]})

    return runs.mapInPandas(run, "restart long, energy double, chosen array<long>")


def vote_score(h: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean vote of the chosen stumps (k)."""
    n = chosen.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    return h.join(F.broadcast(chosen.select("k")), "k").crossJoin(F.broadcast(n)).groupBy(S, "node_id").agg((F.sum("h") / F.max("n")).alias("score"))


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def kernel_ridge(train, y, test, penalty: float = 1.0):
    gamma = 1.0 / train.shape[1]
    alpha = np.linalg.solve(rbf(train, train, gamma) + penalty * np.eye(len(train)), y - y.mean())
    return rbf(test, train, gamma) @ alpha


#: Rows that landmarks are first sought among, rows that a later round adds, and how many landmarks there may be.
SOUGHT, ADDED, LANDMARKS = 2000, 200, 1000


def pivots(k: np.ndarray, tolerance: float) -> np.ndarray:
    """Rows of a kernel matrix with unit diagonal, by pivoted Cholesky: until no row is farther from their span."""
    left, rows, chosen = np.diag(k).copy(), [], []
    while len(chosen) < len(k) and left.max() > tolerance:
        p = int(left.argmax())
        row = (k[p] - sum((r[p] * r for r in rows), np.zeros(len(k)))) / np.sqrt(left[p])
        rows.append(row)
        chosen.append(p)
        left = np.maximum(0, left - row * row)
        left[p] = 0
    return np.array(chosen, int)


def kernel_features(x: DataFrame, cols: list[str], tolerance: float = 1e-3, gamma: float | None = None) -> tuple[DataFrame, int]:
    """(structure_id, node_id, y01, phi array), and its length: features whose products are the RBF kernel of all rows, each
    row's own to within the tolerance.

    Landmarks come from a bounded sample, by pivoted Cholesky. Then the residual of every row is taken, and while some
    row's is larger, the farthest ones join the sample. More than LANDMARKS landmarks are an error.
    """
    gamma = 1.0 / len(cols) if gamma is None else gamma
    rows = cut_lineage(x.select(S, "node_id", "y01", F.array(*[quoted(c).cast("double") for c in cols]).alias("v")))
    sought = rows.orderBy(F.xxhash64(S, "node_id"), S, "node_id").limit(SOUGHT).select("v").collect()
    pool = np.array([r["v"] for r in sought]).reshape(-1, len(cols))
    while True:
        land = pool[pivots(rbf(pool, pool, gamma), tolerance / 2)] if len(pool) else pool
        if len(land) > LANDMARKS:
            raise ValueError(f"more than {LANDMARKS} landmarks are needed for a tolerance of {tolerance}")
        low = np.linalg.cholesky(rbf(land, land, gamma) + 1e-12 * np.eye(len(land)))

        @F.pandas_udf("array<double>")
        def phi(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.linalg.solve(low, rbf(land, np.stack(v.to_list()), gamma)).T)) if len(v) else pd.Series([], dtype=object)

        made = cut_lineage(rows.select(S, "node_id", "y01", "v", phi("v").alias("phi")))
        far = 1.0 - F.aggregate("phi", F.lit(0.0), lambda a, c: a + c * c)
        worst = made.select("v", far.alias("far")).filter(F.col("far") > tolerance).orderBy(F.desc("far"), "v").limit(ADDED).collect()
        if not worst:
            return made.drop("v"), len(land)
        pool = np.concatenate([land, np.array([r["v"] for r in worst])])


def kernel_ridge_transfer(x: DataFrame, cols: list[str], penalty: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """(structure_id, node_id, y01, score): kernel ridge regression as a ridge model of kernel features; folds share sums."""
    made, m = kernel_features(x, cols, tolerance)
    names = [f"k{j}" for j in range(m)]
    flat = made.select(S, "node_id", "y01", *[F.col("phi")[j].alias(n) for j, n in enumerate(names)])
    fits = solved(others(structure_sums(flat, names)), m, penalty)
    score = F.aggregate(F.zip_with("phi", "c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return made.join(fits, S).select(S, "node_id", "y01", score.alias("score"))


def ridge_score(train, y, test, penalty: float = 1.0):
    return test @ np.linalg.solve(train.T @ train + penalty * np.eye(train.shape[1]), train.T @ (y - y.mean()))


def logistic(train, y, test, rounds: int = 600, rate: float = 0.3):
    """Full-batch gradient descent with classes weighted alike."""
    pos = max(1.0, y.sum())
    weight = np.where(y > 0, (len(y) - pos) / pos, 1.0)
    w, b = np.zeros(train.shape[1]), 0.0
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(train @ w + b, -30, 30))) - y) / weight.sum()
        w, b = w - rate * (train.T @ g), b - rate * g.sum()
    return test @ w + b


#: Newton steps of a logistic fit, and the share of the identity that keeps separable labels from running off.
NEWTON, DAMPED = 8, 1e-3


#: Folds: groups of structures, named before the dot, or single structures.
GROUPS, EACH = f"substring_index({S}, '.', 1)", S


def logistic_fits(x: DataFrame, cols: list[str], steps: int = NEWTON, damped: float = DAMPED, folds_by: str = GROUPS) -> DataFrame:
    """(fold, c): for each fold the intercept and coefficients of a logistic model of all others, classes weighted alike.

    Newton's method: a step of all folds is one pass over x, in which tasks add up gradients and second derivatives; what
    reaches the driver is (channels + 1)^2 sums of each fold. A fold is a group of structures, as in `boosted_transfer`, or
    what `folds_by` says.
    """
    fold, d = F.expr(folds_by), len(cols) + 1
    rows = cut_lineage(x.select(fold.alias("fold"), F.col("y01").cast("double").alias("y"), *[quoted(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)]))
    counts = rows.groupBy("fold").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).orderBy("fold").collect()  # a row for each fold
    folds = [r["fold"] for r in counts]
    pos, n = np.array([r["pos"] for r in counts], float), np.array([r["n"] for r in counts], float)
    pos, n = pos.sum() - pos, n.sum() - n
    weight = np.maximum(1.0, n - pos) / np.maximum(1.0, pos)
    at = {f: k for k, f in enumerate(folds)}
    c = np.zeros((len(folds), d))

    def sums(batches):
        g, h = np.zeros((len(folds), d)), np.zeros((len(folds), d, d))
        for pdf in batches:
            u = np.column_stack([np.ones(len(pdf)), pdf[[f"c{k}" for k in range(d - 1)]].to_numpy(float)])
            y, own = pdf["y"].to_numpy(), pdf["fold"].map(at).to_numpy()
            for k in range(len(folds)):
                v, t = u[own != k], y[own != k]
                p = 1 / (1 + np.exp(-np.clip(v @ c[k], -30, 30)))
                w = np.where(t > 0.5, weight[k], 1.0)
                g[k] += v.T @ (w * (p - t))
                h[k] += (v * (w * p * (1 - p))[:, None]).T @ v
        every = np.concatenate([g[:, None, :], h], 1)
        yield pd.DataFrame({"k": np.repeat(np.arange(len(folds)), d + 1), "r": np.tile(np.arange(d + 1), len(folds)), "s": list(every.reshape(-1, d))})

    def added(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, s in zip(zip(pdf["k"], pdf["r"], strict=True), pdf["s"], strict=True):
                total[key] = total[key] + s if key in total else s
        if total:
            yield pd.DataFrame({"k": [k for k, _ in total], "r": [r for _, r in total], "s": list(total.values())})

    for _ in range(steps if folds else 0):
        parts = rows.mapInPandas(sums, "k int, r int, s array<double>").repartition("k", "r").mapInPandas(added, "k int, r int, s array<double>").toArrow()
        total = np.zeros((len(folds), d + 1, d))
        total[parts["k"].to_numpy(), parts["r"].to_numpy()] = np.asarray(parts["s"].combine_chunks().flatten()).reshape(-1, d)
        for k in range(len(folds)):
            c[k] -= np.linalg.solve(total[k, 1:] + damped * np.eye(d), total[k, 0] + damped * c[k])
    return x.sparkSession.createDataFrame([(f, v.tolist()) for f, v in zip(folds, c, strict=True)], "fold string, c array<double>")


def logistic_transfer(x: DataFrame, cols: list[str], **how) -> DataFrame:
    """(structure_id, node_id, y01, score): the log-odds of each structure's rows under the model of the other folds."""
    fits = F.broadcast(logistic_fits(x, cols, **how))  # a row for each group of structures
    # One expression over arrays: a sum of hundreds of columns would be nested as deep.
    products = F.zip_with(F.array(*[quoted(c) for c in cols]).cast("array<double>"), F.slice("c", 2, len(cols)), lambda a, b: a * b)
    score = F.aggregate(products, F.col("c")[0], lambda a, b: a + b)
    return x.join(fits, F.substring_index(S, ".", 1) == F.col("fold")).select(S, "node_id", "y01", score.alias("score"))


def kernel_logistic_transfer(x: DataFrame, cols: list[str], penalty: float = 1.0, tolerance: float = 1e-2) -> DataFrame:
    """(structure_id, node_id, y01, score): log-odds of kernel logistic regression, a logistic model of kernel features.

    The penalty is on the squared norm of the function and of the intercept. Newton steps as in `logistic_fits`, so a step
    moves (landmarks + 1)^2 sums of each fold, however many rows there are.
    """
    made, m = kernel_features(x, cols, tolerance)
    names = [f"k{j}" for j in range(m)]
    return logistic_transfer(made.select(S, "node_id", "y01", *[F.col("phi")[j].alias(n) for j, n in enumerate(names)]), names, damped=penalty)


def best_channel_pooled(x: DataFrame, cols: list[str], folds_by: str = GROUPS) -> DataFrame:
    """(fold, channel, sign, strength): the channel that tells labels best in the rows of all other folds taken together,
    with the sign it has there; ties (to nine digits) by name. A fold without both classes elsewhere has no row."""
    auc = pooled_auc(long_channels(x, cols).withColumn("fold", F.expr(folds_by)), "fold", "channel").filter("auc IS NOT NULL")
    ranked = auc.withColumn("strength", significant(F.greatest("auc", 1 - F.col("auc"))))
    first = Window.partitionBy("fold").orderBy(F.desc("strength"), "channel")
    return ranked.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("fold", "channel", F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("sign"), "strength")


def signed_best(x: DataFrame, cols: list[str]) -> DataFrame:
    """(structure_id, node_id, y01, score): of each structure, the channel that its other folds choose, with their sign; 0
    where they choose none."""
    best = F.broadcast(best_channel_pooled(x, cols))  # a row for each fold
    value = F.coalesce(*[F.when(F.col("channel") == c, F.col("sign") * quoted(c)) for c in cols], F.lit(0.0))
    return x.join(best, F.substring_index(S, ".", 1) == F.col("fold"), "left").select(S, "node_id", "y01", value.alias("score"))


def blended(x: DataFrame, cols: list[str], kernel_cols: list[str] | None = None) -> DataFrame:
    """(structure_id, node_id, y01, model, score): what models of the other folds say of each row: `logistic` and `single` on
    all channels, `linear`, the mean of both's rank percentages, and with `kernel_cols` `kernel` on these and `blend`, the
    mean of all three's. No model sees its own fold."""
    x = cut_lineage(x.select(S, "node_id", "y01", *[quoted(c) for c in cols]))
    models = {"logistic": logistic_transfer(x, cols), "single": signed_best(x, cols)}
    if kernel_cols:
        models["kernel"] = kernel_logistic_transfer(x, kernel_cols)
    models = {k: cut_lineage(v.select(S, "node_id", "score")) for k, v in models.items()}
    mixed = {"linear": blend([models["logistic"], models["single"]])} | ({"blend": blend([models[k] for k in ("logistic", "kernel", "single")])} if kernel_cols else {})
    out = None
    for name, scores in (models | mixed).items():
        one = scores.select(S, "node_id", F.lit(name).alias("model"), "score")
        out = one if out is None else out.unionByName(one)
    return out.join(x.select(S, "node_id", "y01"), [S, "node_id"]).select(S, "node_id", "y01", "model", "score")


def boosted_transfer(x: DataFrame, cols: list[str], trees: int = 200, lean: int | None = None) -> DataFrame:
    """(structure_id, node_id, y01, score): each fold's structures scored by boosted trees of all other folds.

    With `lean`, the trees of a fold see only so many channels, those that tell labels best in the others.
    """
    allowed = None
    if lean:
        auc = channel_auc(x, cols).withColumn("fold", F.substring_index(S, ".", 1))
        allowed = {r["fold"]: r["channels"] for r in lean_folds(auc, lean).collect()}
    return boosting.boosted(x, cols, boosting.Settings(trees), allowed)[0]


# Primitives of symbolic trees, as column functions


def sin_log(x: Column) -> Column:
    return F.sin(F.log(F.abs(x) + 1e-6))


def soft_threshold(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), 4.0 * x))))


def interfere(x: Column, y: Column) -> Column:
    return F.cos(x - y)


def resonate(x: Column, y: Column) -> Column:
    return F.exp(-((x - y) * (x - y)))


def pair_terms(cols: list[str]) -> dict[str, Column]:
    """All terms of one primitive over one or two channels: the candidates of a symbolic search, scored by `channel_auc`."""
    out = {f"sinlog({c})": sin_log(quoted(c)) for c in cols} | {f"thr({c})": soft_threshold(quoted(c)) for c in cols}
    for k, a in enumerate(cols):
        for b in cols[k + 1 :]:
            out |= {f"interf({a},{b})": interfere(quoted(a), quoted(b)), f"reso({a},{b})": resonate(quoted(a), quoted(b))}
    return out


def common_terms(terms: DataFrame, n_folds: int) -> DataFrame:
    """Terms (fold, term) that every fold holds."""
    return terms.groupBy("term").agg(F.countDistinct("fold").alias("n")).filter(F.col("n") == n_folds).select("term")


def channel_usage(pool: DataFrame, chosen: DataFrame, top: int = 4) -> DataFrame:
    """How often each channel is among the chosen stumps (k), the most used first."""
    return pool.join(chosen, "k").groupBy("channel").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "channel").limit(top)


def principal(train: DataFrame, test: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(structure_id, node_id, pc0...): test rows on the train rows' first k components, squashed by the train rows' spread."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [f"c{i}" for i in range(len(cols))]
    put = VectorAssembler(inputCols=names, outputCol="features")
    ready = lambda d: put.transform(d.select(S, "node_id", *[quoted(c).alias(n) for c, n in zip(cols, names, strict=True)]))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(ready(train))
    flat = lambda d: model.transform(ready(d)).select(S, "node_id", *[vector_to_array("pc")[i].alias(f"pc{i}") for i in range(k)])
    spread = flat(train).agg(*[f(f"pc{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    return flat(test).crossJoin(F.broadcast(spread)).select(S, "node_id", *[F.tanh((F.col(f"pc{i}") - F.col(f"m{i}")) / (F.col(f"s{i}") + 1e-9)).alias(f"pc{i}") for i in range(k)])
