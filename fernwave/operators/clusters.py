"""k-means over points of any number: seeds in a few rounds over all tasks, then sums of tasks for every centre.

Points are (structure_id, node_id, v array). A structure's points lie in chunks on any tasks; its centres, k of them or a
few times as many while seeding, are sent to each of its chunks. What is drawn is drawn by a hash of the id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from . import blocks, graph
from .graph import S

CHUNK = 4096
#: Rounds of seeding, and how many seeds each draws for a centre; rounds of moving the centres.
SEEDING, DRAWN, MOVES = 5, 2.0, 20


def chunked(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds `chunk`: about so many points of a structure in each."""
    n = points.groupBy(F.col(S).alias("_of")).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_n"))
    return points.join(n, F.col(S) == F.col("_of")).withColumn("chunk", F.pmod(F.xxhash64("node_id"), F.col("_n"))).select(S, "node_id", "v", "chunk")


def nearest_centre(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point (ties: the first), and the squared distance; some points at a time."""
    own, far = np.zeros(len(v), np.int64), np.zeros(len(v))
    size = (c**2).sum(1)
    for a in range(0, len(v), 1024):
        d = np.maximum(0, (v[a : a + 1024] ** 2).sum(1)[:, None] + size - 2 * v[a : a + 1024] @ c.T)
        own[a : a + 1024], far[a : a + 1024] = d.argmin(1), d.min(1)
    return own, far


def against(points: DataFrame, centres: DataFrame, run, schema: str) -> DataFrame:
    """`run(pdf, v, c)` for each chunk of points, with the structure's centres (structure_id, c array) in their order."""
    chunks = points.select(F.col(S).alias("_of"), "chunk").distinct()
    sent = centres.join(chunks, F.col(S) == F.col("_of")).select(F.col(S).alias("_s"), F.col("chunk").alias("_k"), "at", "c")

    def both(key: tuple, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(own):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        own = own.sort_values("at")
        out = run(pdf, np.stack(pdf["v"].to_list()), np.stack(own["c"].to_list()))
        out.insert(0, S, key[0])
        return out

    return points.groupBy(S, "chunk").cogroup(sent.groupBy("_s", "_k")).applyInPandas(both, schema)


def weighted_seeds(c: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """k of the candidates, each in proportion to its weight times its squared distance from those before, then moved."""
    g = np.random.default_rng(0)
    out = [c[w.argmax()]]
    far = ((c - out[0]) ** 2).sum(1)
    for _ in range(min(k, len(c)) - 1):
        p = w * far
        out.append(c[g.choice(len(c), p=p / p.sum()) if p.sum() > 0 else len(out)])
        far = np.minimum(far, ((c - out[-1]) ** 2).sum(1))
    out = np.stack(out)
    for _ in range(MOVES):
        own, _ = nearest_centre(c, out)
        out = np.stack([np.average(c[own == q], axis=0, weights=w[own == q]) if (own == q).any() else out[q] for q in range(len(out))])
    return out


def seeds(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(structure_id, at, c): k centres a structure by k-means||."""
    u = lambda r: F.shiftrightunsigned(F.xxhash64("node_id", F.lit(seed), F.lit(r)), 12) / float(1 << 52)
    chosen = cut_lineage(points.groupBy(S).agg(F.min_by("v", F.struct(u(-1), "node_id")).alias("c"), F.min(F.struct(u(-1), "node_id")).alias("_x")).select(S, F.lit(0).cast("long").alias("at"), "c"))

    def distance(pdf, v, c):
        return pd.DataFrame({"node_id": pdf["node_id"].to_numpy(), "v": pdf["v"].to_list(), "far": nearest_centre(v, c)[1]})

    for r in range(SEEDING):
        far = cut_lineage(against(points, chosen, distance, f"{S} string, node_id long, v array<double>, far double"))
        cost = far.groupBy(F.col(S).alias("_of")).agg(F.sum("far").alias("cost"))
        new = far.join(cost, F.col(S) == F.col("_of")).filter((F.col("far") > 0) & (u(r) * F.col("cost") < DRAWN * k * F.col("far")))
        chosen = cut_lineage(chosen.unionByName(new.select(S, (F.col("node_id") * SEEDING + r + 1).alias("at"), F.col("v").alias("c"))))

    def counted(pdf, v, c):
        own, n = np.unique(nearest_centre(v, c)[0], return_counts=True)
        return pd.DataFrame({"no": own, "n": n})

    # Candidates are a few times k: their weights meet in one task a structure.
    weight = against(points, chosen, counted, f"{S} string, no long, n long").groupBy(S, "no").agg(F.sum("n").alias("n"))

    def choose(key: tuple, own: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        c, w = np.stack(own["c"].to_list()), np.zeros(len(own))
        w[n["no"].to_numpy()] = n["n"]
        out = weighted_seeds(c[w > 0], w[w > 0], k)
        return pd.DataFrame({S: key[0], "at": np.arange(len(out)), "c": out.tolist()})

    return chosen.groupBy(S).cogroup(weight.withColumnRenamed(S, "_of").groupBy("_of")).applyInPandas(choose, f"{S} string, at long, c array<double>")


def kmeans(points: DataFrame, k: int, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(structure_id, node_id, cluster_id): at most k clusters a structure, numbered without gaps by their least node."""
    points = cut_lineage(chunked(points, chunk))
    centres = cut_lineage(seeds(points, k, seed))

    def sums(pdf, v, c):
        own, _ = nearest_centre(v, c)
        at, n = np.unique(own, return_counts=True)
        return pd.DataFrame({"at": at, "n": n, "total": [v[own == q].sum(0).tolist() for q in at]})

    for _ in range(MOVES):
        part = against(points, centres, sums, f"{S} string, at long, n long, total array<double>")
        flat = part.select(S, "at", "n", F.posexplode("total").alias("j", "t")).groupBy(S, "at", "j").agg((F.sum("t") / F.sum("n")).alias("m"))
        moved = flat.groupBy(S, "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("c"))  # one vector's components
        moved = cut_lineage(moved)
        gap = F.aggregate(F.zip_with("c", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        still = moved.join(centres.select(F.col(S).alias("_of"), F.col("at").alias("_at"), F.col("c").alias("_c")), (F.col(S) == F.col("_of")) & (F.col("at") == F.col("_at"))).filter(gap > 1e-18).isEmpty()
        centres = moved
        if still:
            break
    assigned = cut_lineage(against(points, centres, lambda pdf, v, c: pd.DataFrame({"node_id": pdf["node_id"].to_numpy(), "own": nearest_centre(v, c)[0]}), f"{S} string, node_id long, own long"))
    first = assigned.groupBy(S, "own").agg(F.min("node_id").alias("least"))  # a row for each cluster
    numbered = first.groupBy(S).agg(F.sort_array(F.collect_list("least")).alias("every"))
    number = first.join(numbered, S).select(F.col(S).alias("_of"), F.col("own").alias("_own"), (F.array_position("every", F.col("least")) - 1).alias("cluster_id"))
    return assigned.join(number, (F.col(S) == F.col("_of")) & (F.col("own") == F.col("_own"))).select(S, "node_id", "cluster_id")


def spectral_clusters(nodes: DataFrame, edges: DataFrame, k: int, modes: int | None = None) -> DataFrame:
    """(structure_id, node_id, cluster_id): k-means of the nodes' places in the low modes, each place of length one.

    Modes and clusters both come from rows on any tasks. `modes` counts the constant one, which is left out of graphs in one
    part; in others the zero modes tell the parts apart and all are used.
    """
    w, x = blocks.low_modes(nodes, edges, modes or k, tolerance=1e-6)
    zero = w.filter("w < 1e-5").groupBy(F.col(S).alias("_of")).agg(F.count(F.lit(1)).alias("zero"))
    v = F.array(*blocks.names(modes or k))
    v = F.when(F.col("zero") > 1, v).otherwise(F.slice(v, 2, max(1, (modes or k) - 1)))
    placed = x.join(zero, F.col(S) == F.col("_of"), "left").select(S, "node_id", v.alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)) + 1e-12
    return kmeans(placed.select(S, "node_id", F.transform("v", lambda c: c / size).alias("v")), k)


def rolled(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(structure_id, cluster_id, size, least, inside, outside): each cluster's nodes and the contacts of them, by direction."""
    of = lambda n, c: clusters.select(S, F.col("node_id").alias(n), F.col("cluster_id").alias(c))
    links = edges.join(of("i", "cluster_id"), [S, "i"]).join(of("j", "b"), [S, "j"])
    counts = links.groupBy(S, "cluster_id").agg(F.count_if(F.col("b") == F.col("cluster_id")).alias("inside"), F.count_if(F.col("b") != F.col("cluster_id")).alias("outside"))
    sizes = clusters.groupBy(S, "cluster_id").agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("least"))
    return sizes.join(counts, [S, "cluster_id"], "left").na.fill(0, ["inside", "outside"])
