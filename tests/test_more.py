import json

import numpy as np

from fernwave.operators import circuits, graph, learned, ranking, scoring, spectral
from fernwave.sources import sinks, structures

from clouds import pocket_cloud


def test_planted_pocket_is_found(spark):
    xyz, y = pocket_cloud()
    rows = [("s", i, *map(float, p), int(v), i < 20) for i, (p, v) in enumerate(zip(xyz, y))]
    nodes = spark.createDataFrame(rows, "structure_id string, node_id long, x double, y double, z double, y01 int, is_active boolean")
    edges = graph.contact_edges(nodes, 8.0)
    scores = spectral.band_scores(nodes, edges, "interference", "logf", 1.0)
    ranked = ranking.finalize(scores, nodes.filter("is_active"))
    assert ranked.filter("pos is not null").count() == 46
    auc = scoring.roc_auc(scores.join(nodes.select("structure_id", "node_id", "y01"), ["structure_id", "node_id"])).first().auc
    assert 0 <= auc <= 1
    m = spectral.metric_rows(nodes, edges, "interference")
    direct = {r.node_id: r.score for r in ranking.band_score(m, graph.graph_distance(nodes, edges), nodes).collect()}
    fused = {r.node_id: r.score for r in spectral.band_scores(nodes, edges, "interference").collect()}
    assert all(abs(direct[k] - fused[k]) < 1e-9 for k in direct)  # two plans, one result


def test_gate_lines_usage_terms_and_json(spark):
    e = spark.createDataFrame([("s", 0, 1), ("s", 1, 0), ("s", 1, 2), ("s", 2, 1)], "structure_id string, i long, j long")
    lines = [r.line for r in circuits.gate_lines(circuits.walk_gates(e, 1.0, 2)).collect()]
    assert len(lines) == 8 and lines[0] == "rxx q[0], q[1] theta=0.500000" and lines[1].startswith("ryy")
    pool = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "k int, channel string")
    assert [(r.channel, r.uses) for r in learned.channel_usage(pool, pool.select("k")).collect()] == [("a", 2), ("b", 1)]
    t = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "fold int, term string")
    assert [r.term for r in learned.common_terms(t, 2).collect()] == ["x"]
    hits = spark.createDataFrame([("s", 2, 7), ("s", 1, 9)], "structure_id string, pos int, node_id long")
    doc = json.loads(sinks.submission_json(hits, spark.createDataFrame([("s", 0.5)], "structure_id string, auc double")).first().json)
    assert doc["auc"] == 0.5 and [h["node_id"] for h in doc["hits"]] == [9, 7]


def test_components_and_reuploading(spark):
    g = np.random.default_rng(0)
    rows = [("s", i, float(a), float(a + 0.01 * b)) for i, (a, b) in enumerate(g.normal(size=(100, 2)))]
    x = spark.createDataFrame(rows, "structure_id string, node_id long, a double, b double")
    pc = learned.principal(x, x, ["a", "b"], 1).collect()
    assert all(abs(r.pc0) <= 1 for r in pc) and abs(np.corrcoef([r.pc0 for r in pc], [r[2] for r in rows])[0, 1]) > 0.9
    v = g.random((40, 2))
    y = (v[:, 1] > 0.5).astype(float)  # the ring of two carries the second feature to the first qubit
    p = circuits.reuploading(v, circuits.train_reuploading(v, y, 1, 25))
    assert p[y == 1].mean() > p[y == 0].mean() + 0.2


def test_raw_files_and_active_specs(spark):
    t = spark.createDataFrame([("1ABC_one",), ("2DEF_two",)], "name string")
    f = spark.createDataFrame([("/d/1ABC.pdb",)], "path string")
    assert {r.name: r.raw for r in structures.raw_files(t, f).collect()} == {"1ABC_one": "/d/1ABC.pdb", "2DEF_two": None}
    n = spark.createDataFrame([("s", 0, "A", 5), ("s", 1, "B", 5), ("s", 2, "B", 6)], "structure_id string, node_id long, chain string, resseq int")
    spec = spark.createDataFrame([("s", None, 5), ("s", "A", 6)], "structure_id string, chain string, resseq int")
    assert sorted(r.node_id for r in structures.resolve_active(n, spec).collect()) == [0, 1]
