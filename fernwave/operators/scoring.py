"""How well scores find labelled nodes. Inputs hold (structure_id, y01, score) or (structure_id, y01, pos)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import erfc, significant
from ..functions.ranks import running_sums
from .graph import S


def by_score(x: DataFrame, *by: str) -> DataFrame:
    """(structure_id, by, score, n1, n0, below, lower): positives and negatives of each score, and all and negatives below it.

    Rows are counted by score (to nine digits) first; only the distinct scores are put in order, in ranges over all tasks.
    """
    counts = x.groupBy(S, *by, significant(F.col("score")).alias("score")).agg(F.sum("y01").cast("double").alias("n1"), F.sum(1 - F.col("y01")).cast("double").alias("n0"))
    return running_sums(counts, [S, *by], [F.col("score")], {"below": F.col("n1") + F.col("n0"), "lower": F.col("n0")})


def rank_statistics(x: DataFrame, *by: str) -> DataFrame:
    """AUC, Mann-Whitney U, z with tie and continuity correction, and one-sided p; null where a class is empty.

    Columns of `by` must not bear the results' names.
    """
    if set(by) & {"u", "auc", "z", "p", "n1", "n0", "tied"}:
        raise ValueError(f"columns {by} clash with results")
    ties = F.col("n1") + F.col("n0")
    r = by_score(x, *by).groupBy(S, *by).agg(
        F.sum("n1").alias("n1"),
        F.sum("n0").alias("n0"),
        F.sum(F.col("n1") * (F.col("below") + (ties + 1) / 2.0)).alias("rs"),  # equal scores share their mean rank
        F.sum(ties * ties * ties - ties).alias("t"),
    )
    n = F.col("n1") + F.col("n0")
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    var = F.col("n1") * F.col("n0") / 12.0 * (n + 1 - F.col("t") / (n * (n - 1)))
    z = F.when(var > 0, (u - F.col("n1") * F.col("n0") / 2.0 - 0.5) / F.sqrt(var))
    out = r.select(S, *by, F.when(both, u).alias("u"), F.when(both, u / (F.col("n1") * F.col("n0"))).alias("auc"), F.when(both, z).alias("z"), "n1", "n0", (F.col("t") > 0).alias("tied"))
    return out.withColumn("p", 0.5 * erfc(F.col("z") / F.sqrt(F.lit(2.0))))


def roc_auc(x: DataFrame, *by: str) -> DataFrame:
    return rank_statistics(x, *by).select(S, *by, "auc")


def pooled_auc(x: DataFrame, fold: str, *by: str) -> DataFrame:
    """(fold, by, auc): AUC over the rows of all other folds taken together; null where these lack a class.

    Rows do not cross folds. With U the number of pairs won by positives, a fold's others have U of all rows, less the pairs
    of its own positives with any negative, less those of any positive with its own negatives, plus those within it, which
    were taken away twice. Each comes from sums below a score, over all rows and over the fold's own.
    """
    counts = x.groupBy(*by, fold, significant(F.col("score")).alias("score")).agg(F.sum("y01").cast("double").alias("n1"), F.sum(1 - F.col("y01")).cast("double").alias("n0"))
    counts = running_sums(counts, [*by, fold], [F.col("score")], {"own": F.col("n0")})
    of_all = counts.groupBy(*by, "score").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    of_all = running_sums(of_all, list(by), [F.col("score")], {"lower": F.col("t0"), "under": F.col("t1")})
    one = counts.join(of_all, [*by, "score"]).groupBy(*by, fold).agg(
        F.sum("n1").alias("n1"),
        F.sum("n0").alias("n0"),
        F.sum(F.col("n1") * (F.col("lower") + F.col("t0") / 2.0)).alias("wins"),
        F.sum(F.col("n0") * (F.col("under") + F.col("t1") / 2.0)).alias("beats"),
        F.sum(F.col("n1") * (F.col("own") + F.col("n0") / 2.0)).alias("within"),
    )
    whole = one.groupBy(*by).agg(F.sum("wins").alias("u"), F.sum("n1").alias("p"), F.sum("n0").alias("q"))
    u = F.col("u") - F.col("wins") - (F.col("n0") * F.col("p") - F.col("beats")) + F.col("within")
    pairs = (F.col("p") - F.col("n1")) * (F.col("q") - F.col("n0"))
    return one.join(whole, list(by)).select(fold, *by, F.when(pairs > 0, u / pairs).alias("auc"))


def hits(ranked: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """For each k: whether the top k hold a positive, how many, and how many times more than by chance."""
    out = []
    n, pos = F.count(F.lit(1)), F.sum("y01")
    for k in ks:  # a list that is shorter than k has none of its columns' values
        top = F.sum(F.when(F.col("pos") <= k, F.col("y01")).otherwise(0))
        out += [F.when(n >= k, (top > 0).cast("int")).alias(f"hit_{k}"), F.when(n >= k, top).alias(f"n_hits_{k}"), F.when((n >= k) & (pos > 0), F.round(top / F.lit(float(k)) / (pos / n), 3)).alias(f"enrichment_{k}")]
    return ranked.groupBy(S).agg(*out)


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 from a hash of the parts: the same wherever and whenever it is drawn."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


# The multipliers of a published 32-bit mixing function, and of the golden ratio's sequence.
MIX, GOLDEN = (0x7FEB352D, 0x846CA68B), 0x9E3779B9
#: The cumulative Poisson distribution with mean 1: values above 7 have probability 1e-5.
POISSON = tuple(float(v) for v in np.cumsum(0.36787944117144233 / np.cumprod([1, *range(1, 7)])))


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 32-bit numbers (held as uint64)."""
    low = np.uint64(0xFFFFFFFF)
    for shift, times in ((16, MIX[0]), (15, MIX[1])):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(times)) & low
    return x ^ (x >> np.uint64(16))


def weights(a: np.ndarray, b: np.ndarray, replicates: int) -> np.ndarray:
    """(rows, replicates): how often each row, named by two 32-bit numbers, is drawn in each replicate."""
    step = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)
    h = mixed(mixed((a.astype(np.uint64)[:, None] + step) & np.uint64(0xFFFFFFFF)) ^ b.astype(np.uint64)[:, None])
    return np.searchsorted(np.array(POISSON), (h + 0.5) / float(1 << 32), "right").astype(np.int64)


def bootstrap_auc(x: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(structure_id, ci_low, ci_high): each class resampled with replacement, by Poisson weights of hashed draws.

    Rows are dealt to tasks by ranges of (structure, score, id). A task draws all replicates of its rows as vectors and
    leaves, for each structure, three rows of sums: for its first and last score, which neighbours may share, and for all
    between. These few rows are put together by structure, so one score or structure may hold any share of all rows.
    """
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.md5(F.concat_ws(":", F.col("node_id").cast("string"), F.lit(str(seed))))
    part = lambda k: F.conv(F.substring(named, 1 + 8 * k, 8), 16, 10).cast("long")
    rows = x.filter("score IS NOT NULL AND y01 IS NOT NULL").select(S, significant(F.col("score")).alias("score"), "node_id", F.col("y01").cast("int").alias("y01"), part(0).alias("a"), part(1).alias("b"))
    dealt = rows.repartitionByRange(n, S, "score", "node_id").sortWithinPartitions(S, "score", "node_id").withColumn("part", F.spark_partition_id())

    def draw(batches):
        def done():
            kept = [first, middle, last] if last is not None else [first]
            return pd.DataFrame([(of, at, k, *v) for k, v in enumerate(kept) if v is not None], columns=["of", "part", "k", "score", "n1", "n0", "won"])

        def closed(group):
            """A score's rows: half of its own pairs are won."""
            return group[0], group[1], group[2], group[1] * group[2] / 2

        of, first, middle, last, group, at = None, None, None, None, None, 0
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                piece = pdf.iloc[lo : lo + 512]
                w, y = weights(piece["a"].to_numpy(), piece["b"].to_numpy(), replicates), piece["y01"].to_numpy() > 0
                keys = list(zip(piece[S], piece["score"], strict=True))
                starts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
                for u, v in zip(starts, starts[1:], strict=False):
                    s, score = keys[u]
                    n1, n0 = w[u:v][y[u:v]].sum(0).astype(float), w[u:v][~y[u:v]].sum(0).astype(float)
                    if group is not None and (of, group[0]) == (s, score):
                        group = (score, group[1] + n1, group[2] + n0)
                        continue
                    if group is not None:  # what is open is over: it goes to the first place, or among those between
                        if s != of:
                            first, last = (closed(group), None) if first is None else (first, closed(group))
                            yield done()
                            first = middle = last = None
                        elif first is None:
                            first = closed(group)
                        else:
                            _, a1, a0, won = closed(group)
                            m = middle or (None, 0.0, 0.0, 0.0)
                            middle = (None, m[1] + a1, m[2] + a0, m[3] + won + a1 * m[2])
                    of, group, at = s, (score, n1, n0), int(piece["part"].iloc[0])
        if group is not None:
            first, last = (closed(group), None) if first is None else (first, closed(group))
            yield done()

    def combine(key, pdf):
        pdf = pdf.sort_values(["part", "k"])
        below, won, all1, open_ = 0.0, 0.0, 0.0, None
        for r in [*pdf.itertuples(), None]:
            n1, n0 = (np.asarray(r.n1), np.asarray(r.n0)) if r is not None else (0.0, 0.0)
            if open_ is not None and r is not None and r.k != 1 and r.score == open_[0]:
                open_ = (open_[0], open_[1] + n1, open_[2] + n0)
                continue
            if open_ is not None:
                won = won + open_[1] * (below + open_[2] / 2)
                below, all1, open_ = below + open_[2], all1 + open_[1], None
            if r is not None and r.k == 1:
                won, all1 = won + np.asarray(r.won) + n1 * below, all1 + n1
                below = below + n0
            elif r is not None:
                open_ = (r.score, n1, n0)
        pairs = all1 * below
        auc = (won[pairs > 0] / pairs[pairs > 0]) if len(pdf) else np.zeros(0)
        low, high = np.quantile(auc, [0.025, 0.975]) if len(auc) else (None, None)
        return pd.DataFrame({S: [key[0]], "ci_low": [low], "ci_high": [high]})

    sums = dealt.mapInPandas(draw, "of string, part int, k int, score double, n1 array<double>, n0 array<double>, won array<double>")
    return sums.groupBy("of").applyInPandas(combine, f"{S} string, ci_low double, ci_high double")


#: With so few of one class and no ties, p is exact.
FEW = 8


def exact_tail(u: float, n1: int, n0: int) -> float:
    """Chance of a U of at least u when n1 and n0 scores without ties are in random order."""
    small, large = sorted((n1, n0))
    ways = np.ones(1)
    for i in range(1, small + 1):  # Gaussian binomial: times (1 - q^(large + i)), over (1 - q^i)
        more = np.zeros(len(ways) + large + i)
        more[: len(ways)] += ways
        more[large + i :] -= ways
        for k in range(i):
            more[k::i] = np.cumsum(more[k::i])
        ways = more[: small * large + 1] if len(more) > small * large + 1 else more
    return float(ways[int(np.ceil(u)) :].sum() / ways.sum())


def significance(x: DataFrame, *by: str, replicates: int = 2000) -> DataFrame:
    """(structure_id, auc, ci_low, ci_high, p): p is exact for few untied scores of a class, else by the normal distribution."""

    @F.pandas_udf("double")
    def exact(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        return pd.Series([exact_tail(a, int(b), int(c)) if a == a and min(b, c) > 0 else None for a, b, c in zip(u, n1, n0, strict=True)], dtype="float64")

    r = rank_statistics(x, *by)
    few = (F.least("n1", "n0") <= FEW) & ~F.col("tied") & F.col("u").isNotNull()
    u, n1, n0 = (F.when(few, F.col(c)) for c in ("u", "n1", "n0"))
    p = F.when(few, exact(u, n1, n0)).otherwise(F.col("p"))
    stats = r.select(S, *by, "auc", p.alias("p"))
    keyed = x.select(F.concat_ws("\x1f", S, *by).alias(S), "node_id", "score", "y01")
    part = F.split(S, "\x1f")
    ci = bootstrap_auc(keyed, replicates).select(part[0].alias(S), *[part[k + 1].alias(c) for k, c in enumerate(by)], "ci_low", "ci_high")
    return stats.join(ci, [S, *by], "left")
