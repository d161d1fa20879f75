"""Connected components of a graph of any size: union-find within tasks, then alternating star contractions between them
(Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces

MOST_ROUNDS = 60
#: Edges to a task between rounds, and the least number of tasks.
EACH, LEAST = 1 << 19, 8
#: Edges that a task contracts at once.
CHUNK = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of the edges that is not that least one itself."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(ids)))
    return ids[some], ids[label[some]]


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components, contracted within each task: no more than one for each node and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            u, v = contracted(*(np.concatenate(c) for c in zip(*got, strict=True)))
            return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in batches:
            got.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(g[0]) for g in got) >= CHUNK:
                yield out()
                got.clear()
        if got:
            yield out()

    return edges.mapInArrow(run, "u long, v long")


def small_star(edges: DataFrame) -> DataFrame:
    """All of a node's smaller neighbours, and the node itself, move to the least of them. Edges are (larger, smaller)."""
    least = F.min("v").over(Window.partitionBy("u"))
    moved = edges.select("u", "v", least.alias("m")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").filter("u <> v").distinct()


def large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """All of a node's larger neighbours move to the least of its neighbours and itself."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Sums up in the tasks first, so a node with very many neighbours costs its task one row for each other task.
    # It is written before it is joined: then both sides of the join are plain shuffles, whose skewed parts can be split.
    least = durable(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")).coalesce(tasks))
    moved = near.join(least, near["u"] == least["w"]).filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no other edge's u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (u, v) is connected with; roots themselves included.

    Every round is checkpointed, so plans stay short and a lost executor repeats one round at most. Tasks contract what
    they hold first, so mostly one round is left; rounds go on until nothing is left to move. There are as many tasks as
    the number of edges asks for.
    """
    e = durable(forest(edges.select("u", "v").filter("u <> v")).distinct())
    tasks = pieces(e.count(), EACH, LEAST)
    e = e.coalesce(tasks)
    for _ in range(MOST_ROUNDS):
        e = durable(small_star(e).coalesce(tasks))
        e = durable(large_star(e, tasks).coalesce(tasks))
        if settled(e):
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.coalesce(tasks))
    raise RuntimeError("components did not settle")
