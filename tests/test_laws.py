"""Symbolic laws: trees as arrays, columns and SQL; children; scores over tasks; a planted law is found, and runs agree."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwave.functions import significant_sql
from fernwave.operators import laws, scoring

COLS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def table(spark):
    """Six structures of 60 rows; the label follows a law of depth 3."""
    g = np.random.default_rng(0)
    rows = [(str(s), 100 * s + k, *map(float, g.normal(0, 1, 3))) for s in range(6) for k in range(60)]
    planted = laws.column(["reso", "mul", "x", "y", "thr", "z"])
    return spark.createDataFrame(rows, "structure_id string, node_id long, x double, y double, z double").withColumn("y01", (planted > 0.5).cast("int")).repartition(3).cache()


@pytest.mark.parametrize("s", [laws.LAW_SEARCH, laws.GENERIC_SEARCH])
def test_three_ways_to_evaluate_agree(spark, table, s):
    trees = [laws.first_tree(random.Random(k), s, COLS) for k in range(30)]
    rows = table.select("*", *[laws.column(t).alias(f"t{k}") for k, t in enumerate(trees)]).toPandas()
    con = duckdb.connect()
    con.register("rows", rows)
    for k, t in enumerate(trees):
        with np.errstate(all="ignore"):
            v = laws.value(t, {c: rows[c].to_numpy() for c in COLS}, len(rows))
        assert np.allclose(v, rows[f"t{k}"], rtol=1e-9, atol=1e-12), laws.text(t)
        assert np.allclose(v, con.execute(f"SELECT {laws.to_sql(t)} AS v FROM rows").df()["v"], rtol=1e-9, atol=1e-12), laws.text(t)


def test_children_are_whole_trees():
    for s in (laws.LAW_SEARCH, laws.GENERIC_SEARCH):
        g = random.Random(7)
        pool = [laws.first_tree(g, s, COLS) for _ in range(20)]
        for _ in range(500):
            t = laws.child(g, s, COLS, g.choice(pool), g.choice(pool))
            assert laws.end_of(t, 0) == len(t) <= s.longest
            assert all(x in s.functions or x in COLS or float(x[1:]) is not None for x in t)
            pool[g.randrange(20)] = t
    assert laws.depth(["reso", "mul", "x", "y", "thr", "z"]) == 2 and laws.text(["sub", "x", "#0.5"]) == "sub(x, 0.5)"


def test_scores_over_tasks(spark, table):
    """Binned AUC comes near the exact one, errors are exact, and a fold's own rows are not among those that count."""
    trees = [["x"], ["mul", "x", "y"], ["reso", "mul", "x", "y", "thr", "z"], ["#0.25"]]
    rows = table.withColumn("fold", F.col("structure_id"))
    pdf = rows.toPandas()
    held = spark.createDataFrame([(f, k, t) for f in ("0", "3") for k, t in enumerate(trees)], "fold string, place int, tokens array<string>")
    sample = pdf.head(laws.SAMPLE)
    got = {(r.fold, r.place): r.fitness for r in laws.scored(rows, COLS, held, sample, laws.Search(tuple(laws.PHYSICS), parsimony=0.0)).collect()}
    for (fold, k), a in got.items():
        p = pdf[pdf.fold != fold]
        v, y = laws.value(trees[k], {c: p[c].to_numpy() for c in COLS}, len(p)), p.y01.to_numpy()
        exact = ((v[y == 1][:, None] > v[y == 0]) + 0.5 * (v[y == 1][:, None] == v[y == 0])).mean()
        assert abs(a - exact) < 0.01
    mae = {(r.fold, r.place): -r.fitness for r in laws.scored(rows, COLS, held, sample, laws.Search(tuple(laws.PHYSICS), metric="mae", parsimony=0.0)).collect()}
    for (fold, k), a in mae.items():
        p = pdf[pdf.fold != fold]
        v, y = laws.value(trees[k], {c: p[c].to_numpy() for c in COLS}, len(p)), p.y01.to_numpy()
        w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
        assert abs(a - (w * abs(v - y)).sum() / w.sum()) < 1e-8
    assert len(got) == len(mae) == 8


def test_a_planted_law_is_found_and_runs_agree(spark, table):
    s = laws.Search(tuple(laws.PHYSICS), population=600, generations=15)
    found = laws.search(table, COLS, s, hold_out=False).collect()
    assert len(found) == 1 and found[0].fold == ""
    again = laws.search(table.repartition(5), COLS, s, hold_out=False).collect()
    assert again == found
    out = laws.applied(table, spark.createDataFrame(found))
    auc = {r.structure_id: r.auc for r in scoring.roc_auc(out).collect()}
    assert min(auc.values()) > 0.99
    con = duckdb.connect()
    con.register("rows", table.toPandas())  # SQL re-evaluates the winner
    score = significant_sql(laws.to_sql(list(found[0].tokens)))
    pairs = con.execute(f"WITH v AS (SELECT structure_id, y01, {score} AS s FROM rows) SELECT p.structure_id, avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END) FROM v p JOIN v q ON p.structure_id = q.structure_id AND p.y01 = 1 AND q.y01 = 0 GROUP BY 1").fetchall()
    assert len(pairs) == 6 and all(abs(auc[k] - float(v)) < 1e-6 for k, v in pairs)


def test_folds_learn_from_the_others_only(spark, table):
    """The labels of a fold are turned round: its own law must not follow them."""
    turned = table.withColumn("y01", F.when(F.col("structure_id") == "2", 1 - F.col("y01")).otherwise(F.col("y01")))
    s = laws.Search(tuple(laws.PHYSICS), population=120, generations=6)
    rows = laws.search(turned, COLS, s).collect()
    assert sorted(r.fold for r in rows) == [str(k) for k in range(6)]
    auc = {r.structure_id: r.auc for r in scoring.roc_auc(laws.applied(turned, spark.createDataFrame(rows))).collect()}
    assert auc["2"] < 0.5


def test_nothing_to_learn_from(spark, table):
    assert laws.search(table.limit(0), COLS, laws.Search(tuple(laws.PHYSICS), population=10, generations=2)).collect() == []


def test_channels_may_bear_names_of_functions_and_dots(spark, table):
    odd = table.select("structure_id", "node_id", "y01", F.col("x").alias("interf"), F.col("y").alias("a.b"), F.col("z").alias("abs"))
    rows = laws.search(odd, ["interf", "a.b", "abs"], laws.Search(tuple(laws.GENERIC), metric="mae", population=60, generations=3), hold_out=False).collect()
    got = laws.applied(odd, spark.createDataFrame(rows)).collect()
    assert len(rows) == 1 and len(got) == 360 and all(r.score is not None for r in got)
