"""Work that must not grow with the square of what is near."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fernwave.operators import blocks, boosting, graph
from fernwave.operators.graph import S
from fernwave.plans import catalogue, experiments


def cloud(spark, x, s="a"):
    return spark.createDataFrame(pd.DataFrame({S: s, "node_id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))


@pytest.mark.parametrize("spread", [3.0, 10.0, 30.0])
def test_two_hops_of_contacts_are_counted(spark, spread):
    x = np.random.default_rng(3).normal(size=(700, 3)) * spread
    x[600:] = x[:100]  # several at one place
    x[5, 1], x[6] = np.nan, np.inf
    a = graph.between(x, x) <= 64
    a |= np.eye(len(x), dtype=bool)
    want = int((a.astype(float) @ a.astype(float) > 0).sum())
    got = graph.contact_two_hops(cloud(spark, x).unionByName(cloud(spark, x[:600] + 100, "b"))).toPandas().set_index(S)["pairs"]
    assert got["a"] == want
    assert got["b"] == int((a[:600, :600].astype(float) @ a[:600, :600].astype(float) > 0).sum())


def test_two_hops_within_a_dense_place(spark, tmp_path):
    """4000 points in contact with each other: 64,000,000,000 walks of two hops."""
    x = np.random.default_rng(4).uniform(-0.02, 0.02, (4000, 3)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(4000), "embedding": list(x), "label": np.zeros(4000, np.int32)}).to_parquet(tmp_path / "embeddings.parquet")
    assert entry.queries()["two_hop_pairs"](spark, str(tmp_path)).first()["pairs"] == 4000 * 4000


def test_low_modes_of_long_paths_settle(spark):
    """Low modes of long paths lie so near to each other that iterations tell them apart slowly."""
    sizes = {"long": 1200, "short": 4, "one": 1}
    nodes = spark.createDataFrame([(s, 7 * k) for s, n in sizes.items() for k in range(n)], f"{S} string, node_id long")
    step = spark.createDataFrame([(s, 7 * k, 7 * k + 7) for s, n in sizes.items() for k in range(n - 1)], f"{S} string, i long, j long")
    w, x = blocks.low_modes(nodes, step.unionByName(step.selectExpr(S, "j AS i", "i AS j")))
    got = {(r[S], r.k): r.w for r in w.collect()}
    want = {(s, k): 2 - 2 * np.cos(np.pi * k / n) for s, n in sizes.items() for k in range(min(n, 6))}
    assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-10 for key in want)
    v = x.filter(f"{S} = 'long'").orderBy("node_id").select(*blocks.names(6)).toPandas().to_numpy()
    assert len(v) == 1200 and np.allclose(v.T @ v, np.eye(6), atol=1e-9)


def test_low_modes_are_those_of_whole_structures(spark):
    edges = spark.createDataFrame([(s, a, b) for s, n in (("a", 20), ("b", 8)) for a in range(n) for b in range(n) if a != b and (a * b) % 3 == 1], f"{S} string, i long, j long")
    nodes = spark.createDataFrame([(s, k) for s, n in (("a", 20), ("b", 8)) for k in range(n)], f"{S} string, node_id long")
    one, other = ({(r[S], r.k): r.w for r in blocks.low_modes(nodes, edges, k=3, dense=n)[0].collect()} for n in (100, 10))
    assert one.keys() == other.keys() and all(abs(one[key] - other[key]) < 1e-7 for key in one)


def test_boosting_is_spread_over_tasks(spark):
    x = spark.range(30_000).selectExpr("CAST(id % 3 AS string) AS structure_id", "id AS node_id", "CAST(id % 7 = 0 AS int) AS y01", "CAST(id % 11 AS double) AS v")
    scored, _ = boosting.boosted(x, ["v"], boosting.Settings(trees=1))
    sizes = [r["n"] for r in scored.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 3 and max(sizes) < 12_000


@pytest.fixture
def counted(spark):
    """Two rings, and how often a row of their edges was made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    nodes = spark.createDataFrame([(s, k, k * 1.0, 0.0, 0.0, int(k % 3 == 0)) for s in "ab" for k in range(18)], f"{S} string, node_id long, x double, y double, z double, y01 int")
    edges = spark.createDataFrame([(s, a, (a + d) % 18) for s in "ab" for a in range(18) for d in (1, 17)], f"{S} string, i long, j long")
    return nodes, edges.mapInPandas(run, edges.schema), made


def test_spectral_preservation_makes_edges_once(spark, counted, monkeypatch):
    nodes, edges, made = counted
    monkeypatch.setattr(catalogue, "structures", lambda *_: (nodes, edges))
    assert catalogue.spectral_preservation(spark, "").count() == 2
    assert made.value == 72


def test_retention_makes_edges_once(spark, counted):
    nodes, edges, made = counted
    thirds = lambda n, e, ratio: n.select(S, "node_id", F.expr(f"node_id div {ratio}").alias("cluster_id"))
    assert experiments.retention(nodes, edges, thirds).count() == 6
    assert made.value == 72
