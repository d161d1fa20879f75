"""Queries against their SQL where ids reach into a second block, so that a label has several structures."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fernwave.operators import boosting, learned

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    path = tmp_path_factory.mktemp("grown")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{DATA}/embeddings.parquet' WHERE vec_id < 300 UNION ALL SELECT * REPLACE (vec_id + 10000 AS vec_id) FROM '{DATA}/embeddings.parquet' WHERE vec_id >= 300) TO '{path}/embeddings.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["ctqw_probs", "feat_whiten", "resonance_overlap", "file_targets", "best_channel_pooled", "sink_report"])
def test_several_structures_of_a_label(spark, grown, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{grown}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, grown).toPandas()
    cols = sorted(want.columns)
    key = [c for c in cols if want[c].dtype.kind != "f"]
    a, b = (d[cols].sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert np.allclose(a[c], b[c], atol=1e-5) if a[c].dtype.kind == "f" else a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


def test_bin_edges_are_exact_quantiles(spark):
    """Of more values than an approximate quantile keeps apart."""
    x = spark.range(60_000).selectExpr("CAST(id * 7919 % 60000 AS double) AS v", "CAST(id % 3 AS double) AS w", "CAST(null AS double) AS u")
    edges = boosting.bin_edges(x, ["v", "w", "u"])
    assert edges == [[60_000 * k / 32 - 1 for k in range(1, 32)], [0.0, 1.0, 2.0], []]


@pytest.mark.parametrize("scale", [0.01, 1.0, 1000.0])
def test_annealing_does_not_depend_on_the_scale_of_energies(spark, scale):
    g, n = np.random.default_rng(5), 10
    m = g.normal(size=(n, n))
    m = (m + m.T) * scale
    q = spark.createDataFrame([(a, b, float(m[a, b])) for a in range(n) for b in range(n)], "a int, b int, q double")
    every = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    least = np.einsum("ri,ij,rj->r", every, m, every).min()
    assert abs(learned.anneal(q, 6, 3000).agg({"energy": "min"}).first()[0] - least) < 1e-9 * scale
