import math
import random

import numpy as np
import pytest

from fernwave.operators import ranking, scoring

SCORES = "structure_id string, node_id long, score double"


def test_finalize_masks_but_keeps_scores(spark):
    s = spark.createDataFrame([("s", i, v) for i, v in enumerate([3.0, 9.0, 9.0, float("nan"), float("inf"), None, 1.0])], SCORES)
    r = {x.node_id: (x.score, x.pos) for x in ranking.finalize(s, spark.createDataFrame([("s", 1)], "structure_id string, node_id long")).collect()}
    assert r[2] == (9.0, 1) and r[0] == (3.0, 2) and r[6] == (1.0, 3) and r[1] == (9.0, None)
    assert r[3][1] is r[4][1] is r[5][1] is None


def test_consensus_modes_rank_missing_nodes_last(spark):
    nodes = spark.createDataFrame([("s", i) for i in range(3)], "structure_id string, node_id long")
    r = spark.createDataFrame([("s", "a", 0, 1), ("s", "a", 1, 2), ("s", "a", 2, 3), ("s", "b", 2, 1), ("s", "b", 0, None)], "structure_id string, detector string, node_id long, pos int")
    got = {m: [x.score for x in ranking.consensus(r, nodes, m).orderBy("node_id").collect()] for m in ("min", "mean", "median", "rrf")}
    assert got["min"] == [0, -1, 0] and got["mean"] == [-1.5, -2, -1] and got["median"] == [-1.5, -2, -1]
    assert math.isclose(got["rrf"][0], 1 / 60 + 1 / 63)
    with pytest.raises(ValueError):
        ranking.consensus(r, nodes, "max")


def test_active_scores_leave_out_shells_that_miss_an_active_node(spark):
    nodes = spark.createDataFrame([("s", i, i in (0, 4)) for i in range(5)], "structure_id string, node_id long, is_active boolean")
    m = spark.createDataFrame([("s", i, 0, float(i)) for i in range(5)], "structure_id string, i long, j long, v double")
    d = spark.createDataFrame([("s", i, j, abs(i - j)) for i in range(4) for j in range(4)] + [("s", 4, 4, 0)], "structure_id string, i long, j long, d int")
    assert {r.score for r in ranking.active_score(m, d, nodes).collect()} == {0.0}  # no node reaches both
    raw = {r.node_id: r.score for r in ranking.active_score(m, d, nodes, "none").collect()}
    assert raw == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    far = {r.node_id: r.score for r in ranking.active_score(m, d, nodes, "distance").collect()}
    assert far == {0: 0, 1: 1, 2: 4, 3: 9, 4: 0}
    with pytest.raises(ValueError):
        ranking.active_score(m, d, nodes, True)


def test_auc_and_mann_whitney_match_brute_force(spark):
    g = random.Random(0)
    cases = {"ties": [(g.randint(0, 4), g.randint(0, 1)) for _ in range(40)], "perfect": [(i, int(i > 5)) for i in range(12)], "one class": [(1, 1), (2, 1)]}
    df = spark.createDataFrame([(k, float(s), y) for k, v in cases.items() for s, y in v], "structure_id string, score double, y01 int")
    got = {r.structure_id: r for r in scoring.rank_statistics(df).collect()}
    for k, v in cases.items():
        pos, neg = [s for s, y in v if y], [s for s, y in v if not y]
        if not pos or not neg:
            assert got[k].auc is None and got[k].z is None
            continue
        u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[k].u == u and math.isclose(got[k].auc, u / len(pos) / len(neg))
        n = len(v)
        t = sum(c**3 - c for c in np.unique([s for s, _ in v], return_counts=True)[1].tolist())
        z = (u - len(pos) * len(neg) / 2 - 0.5) / math.sqrt(len(pos) * len(neg) / 12 * (n + 1 - t / (n * (n - 1))))
        assert math.isclose(got[k].z, z, rel_tol=1e-9) and abs(got[k].p - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-6


def test_bootstrap_holds_the_auc(spark):
    g = random.Random(1)
    df = spark.createDataFrame([("s", i, g.gauss(i % 2, 1), i % 2) for i in range(200)], "structure_id string, node_id long, score double, y01 int")
    auc, ci = scoring.roc_auc(df).first().auc, scoring.bootstrap_auc(df, 100).first()
    assert ci.ci_low < auc < ci.ci_high < ci.ci_low + 0.25


def test_hits_and_enrichment(spark):
    r = spark.createDataFrame([("s", i, int(i in (2, 9)), i + 1) for i in range(20)], "structure_id string, node_id long, y01 int, pos int")
    x = scoring.hits(r).first()
    assert (x.hit_5, x.n_hits_5, x.enrichment_5, x.n_hits_10, x.enrichment_10) == (1, 1, 2.0, 2, 2.0)


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from fernwave.functions.ranks import row_numbers, running_sums

    g = random.Random(3)
    rows = [(k, g.randint(0, 30), g.random(), i) for i, k in enumerate([None, "a", "a", "b"] * 100)]
    df = spark.createDataFrame(rows, "g string, v int, s double, id int")
    got = {r.id: (r.below, r.rows) for r in running_sums(df, ["g"], [F.col("s"), F.col("id")], {"below": F.col("v"), "rows": F.lit(1)}).collect()}
    for k, v, s, i in rows:
        before = [r for r in rows if r[0] == k and (r[2], r[3]) < (s, i)]
        assert got[i] == (sum(r[1] for r in before), len(before))
    numbers = sorted(r.n for r in row_numbers(df.filter("g = 'b'"), ["g"], [F.desc("id")], "n").collect())
    assert numbers == list(range(100))


def test_p_is_exact_for_few_and_normal_for_many(spark):
    import itertools

    few = [("few", i, s, int(i < 3)) for i, s in enumerate([0.1, 0.7, 0.9, 0.2, 0.3, 0.5, 0.8])]
    tied = [("tied", i, s, int(i < 3)) for i, s in enumerate([0.1, 0.7, 0.9, 0.1, 0.3, 0.5, 0.8])]
    df = spark.createDataFrame(few + tied, "structure_id string, node_id long, score double, y01 int")
    got = {r.structure_id: r for r in scoring.significance(df, replicates=20).collect()}
    u = sum(a > b for a in (0.1, 0.7, 0.9) for b in (0.2, 0.3, 0.5, 0.8))
    every = [sum(r) - 6 for r in itertools.combinations(range(1, 8), 3)]
    assert math.isclose(got["few"].p, sum(x >= u for x in every) / len(every)) and got["few"].ci_low is not None
    assert math.isclose(got["tied"].p, {r.structure_id: r.p for r in scoring.rank_statistics(df).collect()}["tied"])
    with pytest.raises(ValueError):
        scoring.rank_statistics(df.withColumn("p", df["score"]), "p")


def test_lists_shorter_than_k_have_no_hits_of_k(spark):
    r = spark.createDataFrame([("s", i, int(i == 1), i + 1) for i in range(6)], "structure_id string, node_id long, y01 int, pos int")
    x = scoring.hits(r).first()
    assert (x.hit_5, x.n_hits_5, x.hit_10, x.n_hits_10, x.enrichment_10) == (1, 1, None, None, None)


def test_what_is_equal_in_exact_arithmetic_ties(spark):
    """On a ring all nodes are alike: scores from an eigensystem differ in their last digits, and the smaller id comes first."""
    import numpy as np
    from pyspark.sql import functions as F

    from fernwave.functions import significant, significant_array, significant_sql
    from fernwave.operators import spectral

    n = 30
    nodes = spark.createDataFrame([("r", k, 0.0, 0.0, 0.0) for k in range(n)], "structure_id string, node_id long, x double, y double, z double")
    edges = spark.createDataFrame([("r", k, (k + s) % n) for k in range(n) for s in (1, -1)], "structure_id string, i long, j long")
    scores = spectral.band_scores(nodes, edges, "interference", "laplacian", None, 3).cache()
    assert scores.select("score").distinct().count() > 1  # the noise is there
    assert [r.node_id for r in ranking.finalize(scores).orderBy("pos").collect()] == list(range(n))
    pct = ranking.rank_percent(scores, "score").orderBy("node_id").collect()
    assert [r.score_pct for r in pct] == [k / (n - 1) for k in range(n)]

    import duckdb

    values = [0.0, -0.0, 1e-17, 0.009739318896733525, 0.009739318896733518, -123456789.49999, 1e300, -2.5e-9, 0.1 + 0.2, float("inf")]
    a = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(significant(F.col("v")).alias("v")).collect()]
    b = significant_array(np.array(values)).tolist()
    c = [duckdb.sql(f"SELECT {significant_sql('v')} FROM (SELECT {v!r}::DOUBLE AS v)".replace("inf", "'inf'")).fetchall()[0][0] for v in values]
    assert np.allclose(a, b, rtol=1e-15) and np.allclose(a, c, rtol=1e-15) and a[3] == a[4] and a[2] == 0
