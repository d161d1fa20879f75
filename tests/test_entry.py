"""The registered queries on the smallest tables, against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fernwave.plans import catalogue

DATA = "/root/testdata/sf0.001"
SAMPLE = [
    "contact_degree", "knn_edges", "ham_logf", "active_zscore", "consensus_rrf", "roc_auc", "mann_whitney_u", "qboost_qubo", "loo_best_feature", "resistance_foster", "rowsum_yukawa", "hit_enrichment",
    "path_contrast", "path_bank12", "path_gauge", "ring_bank23", "knn_interference", "knn_gnm", "cheb_coefficients", "stochastic_connectivity", "file_pocket_labels", "file_bfactors", "sink_submission",
    "ridge_transfer_xyz", "operator_divergence", "adaptive_pool", "routed_hits", "heat_commute_mass", "gbt_splits", "gbt_leaves", "gbt_scores", "format_atoms", "format_atoms_filtered", "committed_targets",
    "blend_linear", "best_channel_pooled", "path_agreement",
]


def test_every_query_has_a_name_and_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f":
            assert (a[c].fillna(-1e9) - b[c].fillna(-1e9)).abs().max() < 1e-5, c
        else:
            assert a[c].tolist() == b[c].tolist(), c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and max(r.pos for r in rows) <= 5
