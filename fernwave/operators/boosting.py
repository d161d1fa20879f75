"""Gradient boosting of depth-2 trees by histograms: the models of all folds grow together, a level a pass.

Channels are cut into bins once. In a pass tasks add up, for each fold, weights and weighted residuals by tree node, channel and
bin; the driver gets those sums (folds x 2 nodes x channels x BINS numbers, whatever the rows) and picks the splits. Every row
carries its score under every fold's model, its own fold's among them, which that fold's model never learned from: so the
last scores are the answer. Scores are brought up to date and checkpointed every `HELD` trees; between, tasks apply the trees
that came since, so a lost executor costs the rows' last few trees.

A fold is a group of structures, named by what comes before a '.' in their names. Null channels fall into the lowest bin, NaN
into the highest; a null label is negative. Equal gains go to the channel and the bin that come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import significant_array
from ..functions.lineage import cut_lineage
from ..functions.ranks import running_sums
from .graph import S

#: Bins of a channel; trees between two checkpoints of the scores; rows that a task should hold at least, while there are
#: fewer tasks than run at once.
BINS, HELD, ROWS = 32, 25, 10_000
#: Nodes of a tree: the root, its children, and the leaves' values.
ROOT, LEFT, RIGHT = range(3)


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    rate: float = 0.05
    share: float = 0.8  # of the rows, drawn anew for each tree
    seed: int = 0


@dataclass
class Forest:
    """Trees of all folds. A row goes right at node n if its bin of channel[.., n] is above cut[.., n]; BINS: never."""

    cols: list[str]
    edges: list[list[float]]
    folds: list[str]
    start: np.ndarray  # (folds)
    channel: np.ndarray  # (trees, folds, 3)
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray  # (trees, folds, 4), without the rate

    def splits(self, spark) -> DataFrame:
        """(fold, tree, node, channel, threshold, gain): rows above the threshold go right."""
        t, k, n = np.nonzero(self.cut < BINS)
        at = [(self.channel[p], self.cut[p]) for p in zip(t, k, n, strict=True)]
        rows = [(self.folds[b], int(a), int(c), self.cols[ch], float(self.edges[ch][cut]), float(self.gain[a, b, c])) for a, b, c, (ch, cut) in zip(t, k, n, at, strict=True)]
        return spark.createDataFrame(rows, "fold string, tree int, node int, channel string, threshold double, gain double")

    def leaves(self, spark) -> DataFrame:
        """(fold, tree, leaf, value): leaves 0 and 1 are below the left child, 2 and 3 below the right one."""
        rows = [(self.folds[k], t, leaf, float(self.value[t, k, leaf])) for t in range(len(self.value)) for k in range(len(self.folds)) for leaf in range(4)]
        return spark.createDataFrame(rows, "fold string, tree int, leaf int, value double")

    def importance(self, spark) -> DataFrame:
        """(fold, channel, importance): each channel's share of the gains of a fold's trees; zero where nothing was gained."""
        total = np.zeros((len(self.folds), len(self.cols)))
        t, k, n = np.nonzero(self.cut < BINS)
        np.add.at(total, (k, self.channel[t, k, n]), self.gain[t, k, n])
        total /= np.maximum(total.sum(1, keepdims=True), 1e-300)
        rows = [(f, c, float(total[a, b])) for a, f in enumerate(self.folds) for b, c in enumerate(self.cols)]
        return spark.createDataFrame(rows, "fold string, channel string, importance double")


def bin_edges(x: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """For each channel its distinct quantiles, bins - 1 at most: the greatest values of all bins but the last."""
    values = F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(cols)])
    counts = cut_lineage(x.select(F.explode(values).alias("r")).select("r.*").filter("v IS NOT NULL AND NOT isnan(v)").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    placed = running_sums(counts, ["c"], [F.col("v")], {"below": F.col("n")})
    total = F.broadcast(counts.groupBy("c").agg(F.sum("n").alias("every")))  # a row for each channel
    # The k-th quantile is the value of rank ceil(k n / bins): so many quantiles lie at or below a rank.
    upto = lambda rank: F.least(F.lit(bins - 1), F.floor(rank * bins / F.col("every")))
    rows = placed.join(total, "c").filter(upto(F.col("below") + F.col("n")) > upto(F.col("below"))).select("c", "v").collect()  # bins - 1 of a channel
    return [sorted(r["v"] for r in rows if r["c"] == k) for k in range(len(cols))]


def drawn(key: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Whether a tree sees a row: a hash of the row's key and the tree, mixed as in splitmix64."""
    if s.share >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(s.seed * 1_000_003 + tree + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / 2.0**53 < s.share


def went_right(bins: np.ndarray, channel: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf (0 to 3) of every row in one tree (three nodes); bins are (channels, rows)."""
    right = bins[channel[ROOT]] > cut[ROOT]
    return 2 * right + np.where(right, bins[channel[RIGHT]] > cut[RIGHT], bins[channel[LEFT]] > cut[LEFT])


def best_splits(w: np.ndarray, g: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Channel, cut and gain for each leading index of sums (.., channels, BINS) of weights and weighted residuals."""
    lw, lg = np.cumsum(w, -1)[..., :-1], np.cumsum(g, -1)[..., :-1]
    rw, rg = w.sum(-1, keepdims=True) - lw, g.sum(-1, keepdims=True) - lg
    sound = (lw > 1e-9) & (rw > 1e-9) & allowed[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(sound, lw * rw / (lw + rw) * (lg / lw - rg / rw) ** 2, 0.0)
    flat = significant_array(gain).reshape(*gain.shape[:-2], -1)
    at = flat.argmax(-1)
    top = np.take_along_axis(flat, at[..., None], -1)[..., 0]
    some = top > 1e-12
    return np.where(some, at // gain.shape[-1], 0), np.where(some, at % gain.shape[-1], w.shape[-1]), np.where(some, top, 0.0)


def boosted(x: DataFrame, cols: list[str], settings: Settings = Settings(), allowed: dict[str, list[str]] | None = None) -> tuple[DataFrame, Forest]:
    """(structure_id, node_id, y01, score), each structure scored by trees of all other folds, and these trees.

    Classes weigh alike. With `allowed`, the trees of a fold see only its channels of that dictionary.
    """
    spark, fold = x.sparkSession, F.substring_index(S, ".", 1)
    label = F.coalesce(F.col("y01").cast("double"), F.lit(0.0))
    edges = bin_edges(x, cols)
    counts = x.groupBy(fold.alias("fold")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n")).orderBy("fold").collect()  # groups, not structures
    folds = [r["fold"] for r in counts]
    nf, nc, width = len(counts), len(cols), len(cols) * BINS
    pos, n = np.array([r["pos"] for r in counts], float), np.array([r["n"] for r in counts], float)
    rows, (pos, n) = int(n.sum()), (pos.sum() - pos, n.sum() - n)
    heavy = np.maximum(1.0, n - pos) / np.maximum(1.0, pos)
    start = np.where(n > 0, heavy * pos / np.maximum(1e-300, heavy * pos + n - pos), 0.0)
    mask = np.array([[c in allowed[f] if allowed is not None else True for c in cols] for f in folds], bool).reshape(nf, nc)
    shape = (settings.trees, nf, 3)
    forest = Forest(cols, edges, folds, start, np.zeros(shape, int), np.full(shape, BINS), np.zeros(shape), np.zeros((settings.trees, nf, 4)))
    if not folds:
        return x.select(S, "node_id", "y01", F.lit(None).cast("double").alias("score")), forest

    names = [f"b{k}" for k in range(nc)]
    few = max(1, min(rows // ROWS, spark.sparkContext.defaultParallelism))
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")).cast("int") - 1
    place = F.coalesce(place, F.lit(folds.index(None) if None in folds else -1))

    def bin_of(k: int):
        known = F.array(*[F.lit(e) for e in edges[k]]).cast("array<double>")  # none for a channel without values: all rows in bin 0
        return F.coalesce(F.size(F.filter(known, lambda e: F.col(f"v{k}") > e)), F.lit(0)).cast("tinyint")

    # Two steps, so that no name of a channel meets one given here.
    plain = x.select(S, "node_id", "y01", fold.alias("fold"), label.alias("y"), F.xxhash64(S, "node_id").alias("key"), *[F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(cols)])
    held = plain.select(S, "node_id", "y01", place.alias("own"), "y", "key", *[bin_of(k).alias(b) for k, b in enumerate(names)], F.array(*[F.lit(float(v)) for v in start]).alias("scores"))
    held = cut_lineage(held.repartition(few, "key"))

    def advanced(batch: pa.RecordBatch, trees: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Bins (channels, rows), and scores (folds, rows) after these trees."""
        bins = np.array([batch[b].to_numpy() for b in names], np.int8).reshape(nc, len(batch))
        scores = np.array(batch["scores"].flatten().to_numpy().reshape(len(batch), nf).T, order="C")
        for channel, cut, value in trees:
            for k in range(nf):
                scores[k] += settings.rate * value[k][went_right(bins, channel[k], cut[k])]
        return bins, scores

    def grown(since: int, tree: int) -> list[tuple]:
        """What tasks need of the trees from one to before another: only these are sent."""
        return [(forest.channel[t], forest.cut[t], forest.value[t]) for t in range(since, tree)]

    def sums(tree: int, since: int, level: int) -> np.ndarray:
        """(2, folds, nodes, channels, BINS): weights and weighted residuals of the rows drawn for a tree."""
        trees, channel, cut = grown(since, tree), forest.channel[tree, :, ROOT], forest.cut[tree, :, ROOT]

        def run(batches):
            total, nodes = np.zeros((2, nf, level + 1, width)), level + 1
            for batch in batches:
                bins, scores = advanced(batch, trees)
                see = drawn(batch["key"].to_numpy(), tree, settings)
                bins, scores, y, own = bins[:, see], scores[:, see], batch["y"].to_numpy()[see], batch["own"].to_numpy()[see]
                cell = np.arange(nc)[:, None] * BINS + bins
                for k in range(nf):
                    w = np.where(own == k, 0.0, np.where(y > 0.5, heavy[k], 1.0))
                    at = (cell + width * (bins[channel[k]] > cut[k]) if level else cell).ravel()
                    total[0, k] += np.bincount(at, np.tile(w, nc), nodes * width).reshape(nodes, width)
                    total[1, k] += np.bincount(at, np.tile(w * (y - scores[k]), nc), nodes * width).reshape(nodes, width)
            flat = total.reshape(2, -1)
            some = np.flatnonzero(flat[0])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[0, some]), pa.array(flat[1, some])], ["cell", "w", "g"])

        got = held.select("own", "y", "key", "scores", *names).mapInArrow(run, "cell long, w double, g double").groupBy("cell").agg(F.sum("w").alias("w"), F.sum("g").alias("g")).toArrow()
        out = np.zeros((2, nf * (level + 1) * width))
        cell = got["cell"].to_numpy()
        out[0, cell], out[1, cell] = got["w"].to_numpy(), got["g"].to_numpy()
        return out.reshape(2, nf, level + 1, nc, BINS)

    def brought_up(trees: list[tuple]) -> DataFrame:
        def run(batches):
            for batch in batches:
                scores = advanced(batch, trees)[1].T.ravel()
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * nf), pa.array(scores))
                yield batch.set_column(batch.schema.get_field_index("scores"), "scores", made)

        return held.mapInArrow(run, held.schema)

    since = 0
    for tree in range(settings.trees):
        w, g = sums(tree, since, 0)
        forest.channel[tree, :, ROOT], forest.cut[tree, :, ROOT], forest.gain[tree, :, ROOT] = (v[:, 0] for v in best_splits(w, g, mask[:, None, :]))
        w, g = sums(tree, since, 1)
        forest.channel[tree, :, LEFT:], forest.cut[tree, :, LEFT:], forest.gain[tree, :, LEFT:] = best_splits(w, g, mask[:, None, :])
        for k in range(nf):
            for child in range(2):
                ch, cut = forest.channel[tree, k, LEFT + child], forest.cut[tree, k, LEFT + child]
                for side, part in enumerate((slice(None, cut + 1), slice(cut + 1, None))):
                    weight = w[k, child, ch, part].sum()
                    forest.value[tree, k, 2 * child + side] = g[k, child, ch, part].sum() / weight if weight > 1e-9 else 0.0
        if tree + 1 - since == HELD and tree + 1 < settings.trees:
            held, since = cut_lineage(brought_up(grown(since, tree + 1))), tree + 1
    return cut_lineage(brought_up(grown(since, settings.trees))).select(S, "node_id", "y01", F.get("scores", "own").alias("score")), forest
