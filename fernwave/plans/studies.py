"""Queries of whole studies: transfer between structures, noise, coarse graphs, hit-list variants and the routed answer."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import significant_sql
from ..functions.lineage import cut_lineage, shared_folder
from ..operators import features, graph, learned, ranking, scoring, spectral
from ..operators.graph import S
from ..sources import sinks
from ..sources.points import embedding_nodes
from . import experiments
from .catalogue import AUCS, CH, NODES, SQL, VOTES, _aucs, _channels, _inverse_normal_sql, _thirds, _z, coarse_clusters, query, structures, with_
from .spectra import _GNM, BANK12, LOGF_LAP, PATH, _per_node, exponentials, paths

# Ridge operators on three channels; SQL solves the 3 x 3 systems by Cramer's rule.


def _sums_sql(table: str, by: str) -> str:
    """Columns of sums over `table` (label, p, q, r, y): n, sy, and products of channels with each other, labels and ones."""
    pairs = [f"{a}{b}" for k, a in enumerate("pqr") for b in "pqr"[k:]]
    cols = ["count(*)::DOUBLE AS n", "sum(y)::DOUBLE AS sy"] + [f"sum({a} * {b}) AS s{a}{b}" for a, b in pairs] + [f"sum({a} * y) AS y{a}" for a in "pqr"] + [f"sum({a}) AS t{a}" for a in "pqr"]
    return f"SELECT {by}, {', '.join(cols)} FROM {table} GROUP BY {by}"


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _solve_sql(sums: str, penalty: float) -> str:
    """(label, c1, c2, c3) from a table of sums."""
    m = [[f"(s{min(a, b)}{max(a, b)}{f' + {penalty}::DOUBLE' if a == b else ''})" for b in "pqr"] for a in "pqr"]
    v = [f"(y{a} - sy / n * t{a})" for a in "pqr"]
    cols = []
    for k in range(3):
        cols.append(f"{_det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)])} / {_det(m)} AS c{k + 1}")
    return f"SELECT label, {', '.join(cols)} FROM {sums}"


_ALL_SUMS = ["n", "sy"] + [f"s{a}{b}" for k, a in enumerate("pqr") for b in "pqr"[k:]] + [f"{x}{a}" for x in "yt" for a in "pqr"]
STANDARD = NODES + ", zs AS (SELECT label, node_id, CAST(node_id % 3 = 0 AS INTEGER) AS y, " + ", ".join(f"{_z(c)} AS {d}" for c, d in zip(CH, "pqr", strict=True)) + " FROM nodes WINDOW w AS (PARTITION BY label))"


def _folds_sql(name: str, table: str, penalty: float = 1.0) -> str:
    """Table `name` (label, node_id, y, score): every structure scored by a ridge model of the others."""
    rest = ", ".join(f"(SELECT sum({c}) FROM {name}_o) - {c} AS {c}" for c in _ALL_SUMS)
    return f""", {name}_o AS ({_sums_sql(table, 'label')}), {name}_t AS (SELECT label, {rest} FROM {name}_o), {name}_c AS ({_solve_sql(name + '_t', penalty)}),
{name} AS (SELECT label, node_id, y, p * c1 + q * c2 + r * c3 AS score FROM {table} JOIN {name}_c USING (label))"""


def _auc_sql(table: str, by: str = "label") -> str:
    """Mean-rank AUC of a table (by, score, y)."""
    return f"SELECT {by}, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS rk FROM {table}) GROUP BY {by}"


@query(with_(STANDARD + _folds_sql("f", "zs"), f"SELECT CAST(label AS VARCHAR) AS structure_id, round(auc, 6) AS auc FROM ({_auc_sql('f')})"))
def ridge_transfer_xyz(spark, sf_dir):
    x = features.zscore(_channels(spark, sf_dir), CH)
    return scoring.roc_auc(learned.ridge_transfer(x, CH)).select(S, F.round("auc", 6).alias("auc"))


_FITS = STANDARD + f", os AS ({_sums_sql('zs', 'label')}), oc AS ({_solve_sql('os', 2.0)}), un AS (SELECT *, sqrt(c1 * c1 + c2 * c2 + c3 * c3) AS nm FROM oc)"
_COSINES = _FITS + ", cs AS (SELECT a.label AS la, b.label AS lb, (a.c1 * b.c1 + a.c2 * b.c2 + a.c3 * b.c3) / ((a.nm + 1e-12) * (b.nm + 1e-12)) AS cosine FROM un a JOIN un b ON CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR))"


def _fits(spark, sf_dir):
    return learned.operator_fits(features.zscore(_channels(spark, sf_dir), CH), CH, 2.0)


@query(with_(_FITS, "SELECT CAST(label AS VARCHAR) AS structure_id, round(c1, 6) + 0.0 AS x, round(c2, 6) + 0.0 AS y, round(c3, 6) + 0.0 AS z FROM oc"))
def operator_fit(spark, sf_dir):
    return _fits(spark, sf_dir).select(S, *[(F.round(F.col("c")[k], 6) + 0.0).alias(c) for k, c in enumerate(CH)])


@query(with_(_COSINES, "SELECT CAST(la AS VARCHAR) AS structure_id, CAST(lb AS VARCHAR) AS other, round(cosine, 6) + 0.0 AS cosine FROM cs"))
def operator_cosines(spark, sf_dir):
    return learned.operator_agreement(_fits(spark, sf_dir)).select(S, "other", (F.round("cosine", 6) + 0.0).alias("cosine"))


@query(
    with_(
        _COSINES,
        """, mp AS (SELECT * FROM cs ORDER BY cosine, CAST(la AS VARCHAR), CAST(lb AS VARCHAR) LIMIT 1)
SELECT CAST(la AS VARCHAR) AS structure_id, CAST(lb AS VARCHAR) AS other, round(cosine, 6) + 0.0 AS cosine, channel, round(gap, 6) + 0.0 AS gap
FROM (SELECT la, lb, cosine, unnest(['x', 'y', 'z']) AS channel, unnest([abs(a.c1 / (a.nm + 1e-9) - b.c1 / (b.nm + 1e-9)), abs(a.c2 / (a.nm + 1e-9) - b.c2 / (b.nm + 1e-9)), abs(a.c3 / (a.nm + 1e-9) - b.c3 / (b.nm + 1e-9))]) AS gap FROM mp JOIN un a ON a.label = la JOIN un b ON b.label = lb)""",
    )
)
def operator_divergence(spark, sf_dir):
    """The pair of structures whose operators agree least, and the channels that part them."""
    out = learned.most_divergent(_fits(spark, sf_dir), CH)
    return out.select(S, "other", (F.round("cosine", 6) + 0.0).alias("cosine"), "channel", (F.round("gap", 6) + 0.0).alias("gap"))


@query(with_(_FITS, "SELECT zs.node_id, round(p * c1 + q * c2 + r * c3, 6) + 0.0 AS score FROM zs JOIN oc USING (label)"))
def operator_apply(spark, sf_dir):
    x = features.zscore(_channels(spark, sf_dir), CH)
    return learned.applied(x, CH, learned.operator_fits(x, CH, 2.0)).select("node_id", (F.round("score", 6) + 0.0).alias("score"))


@query(with_(_FITS, "SELECT structure_id, term, coefficient FROM (SELECT CAST(label AS VARCHAR) AS structure_id, term, round(c, 6) + 0.0 AS coefficient, row_number() OVER (PARTITION BY label ORDER BY abs(c) DESC, term) AS r FROM (SELECT label, unnest(['x', 'y', 'z']) AS term, unnest([c1, c2, c3]) AS c FROM oc)) WHERE r <= 2"))
def formula_terms(spark, sf_dir):
    """Each structure's two strongest terms."""
    rows = F.array(*[F.struct(F.lit(c).alias("term"), F.col("c")[k].alias("coefficient")) for k, c in enumerate(CH)])
    one = _fits(spark, sf_dir).select(S, F.explode(rows).alias("r")).select(S, "r.*")
    w = Window.partitionBy(S).orderBy(F.desc(F.abs("coefficient")), "term")
    return one.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").select(S, "term", (F.round("coefficient", 6) + 0.0).alias("coefficient"))


# Three spaces and their stack. SQL takes the inverse root of the 3 x 3 covariance by a coupled Newton iteration.
_RG = ", ug AS (SELECT label, node_id, CAST(node_id % 3 = 0 AS INTEGER) AS y, " + ", ".join(f"least(greatest((row_number() OVER (PARTITION BY label ORDER BY {c}, node_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY label), 1e-6), 1 - 1e-6) AS u{c}" for c in CH) + " FROM nodes), gs AS (SELECT label, node_id, y, " + ", ".join(f"{_inverse_normal_sql('u' + c)} AS {d}" for c, d in zip(CH, "pqr", strict=True)) + " FROM ug)"
_ROOT_ROUNDS = 30


def _whitened_sql() -> str:
    cov = " UNION ALL ".join(f"SELECT label, {i} AS i, {j} AS j, covar_samp({a}, {b}) + {1e-6 if i == j else 0.0!r}::DOUBLE AS v FROM nodes GROUP BY label" for i, a in enumerate(CH) for j, b in enumerate(CH))
    parts = [f"cv AS ({cov})", "tr AS (SELECT label, sum(v) AS s FROM cv WHERE i = j GROUP BY label)", "ry0 AS (SELECT label, i, j, v / s AS v FROM cv JOIN tr USING (label))", "rz0 AS (SELECT label, i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM cv)"]
    mul = lambda a, b: f"SELECT a.label, a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.label = b.label AND a.j = b.i GROUP BY 1, 2, 3"
    for k in range(_ROOT_ROUNDS):
        parts.append(f"rt{k} AS MATERIALIZED (SELECT label, i, j, (CASE WHEN i = j THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END - v) / 2 AS v FROM ({mul(f'rz{k}', f'ry{k}')}))")
        parts.append(f"ry{k + 1} AS MATERIALIZED ({mul(f'ry{k}', f'rt{k}')})")
        parts.append(f"rz{k + 1} AS MATERIALIZED ({mul(f'rt{k}', f'rz{k}')})")
    parts.append(f"iw AS (SELECT label, i, j, v / sqrt(s) AS v FROM rz{_ROOT_ROUNDS} JOIN tr USING (label))")
    parts.append("ce AS (SELECT label, node_id, CAST(node_id % 3 = 0 AS INTEGER) AS y, unnest([0, 1, 2]) AS i, unnest([x - avg(x) OVER w, y - avg(y) OVER w, z - avg(z) OVER w]) AS v FROM nodes WINDOW w AS (PARTITION BY label))")
    parts.append("ws AS (SELECT label, node_id, y, " + ", ".join(f"sum(CASE WHEN j = {k} THEN ce.v * iw.v ELSE 0 END) AS {d}" for k, d in enumerate("pqr")) + " FROM ce JOIN iw USING (label, i) GROUP BY 1, 2, 3)")
    return ", " + ",\n".join(parts)


_SPACES = STANDARD + _RG + _whitened_sql()


@query(with_(_SPACES, "SELECT node_id, round(p, 5) + 0.0 AS x, round(q, 5) + 0.0 AS y, round(r, 5) + 0.0 AS z FROM ws"))
def whitened_channels(spark, sf_dir):
    w = features.whiten(_channels(spark, sf_dir), CH)
    return w.select("node_id", *[(F.round(c, 5) + 0.0).alias(c) for c in CH])


_STACK = _SPACES + _folds_sql("f1", "zs") + _folds_sql("f2", "gs") + _folds_sql("f3", "ws")
_PCT = "(row_number() OVER (PARTITION BY label ORDER BY round(score, 9), node_id) - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY label) - 1)"
_STACKED = _STACK + ", sk AS (SELECT label, node_id, any_value(y) AS y, round(avg(pct), 9) AS score FROM (" + " UNION ALL ".join(f"SELECT label, node_id, y, {_PCT} AS pct FROM {t}" for t in ("f1", "f2", "f3")) + ") GROUP BY 1, 2)"


@query(with_(_STACKED, f"SELECT CAST(label AS VARCHAR) AS structure_id, round(auc, 6) AS auc FROM ({_auc_sql('sk')})"))
def stacked_spaces(spark, sf_dir):
    """Ridge models of three spaces, each left one structure out, stacked by their mean rank percentages."""
    x = _channels(spark, sf_dir)
    out = []
    for name in ("zscore", "rank_gauss", "whiten"):
        space = features.TRANSFORMS[name](x, CH).drop("y01").join(x.select(S, "node_id", "y01"), [S, "node_id"])
        out.append(learned.ridge_transfer(space, CH).withColumn("score", F.round("score", 9)))
    mixed = ranking.blend(out).withColumn("score", F.round("score", 9)).join(x.select(S, "node_id", "y01"), [S, "node_id"])
    return scoring.roc_auc(mixed).select(S, F.round("auc", 6).alias("auc"))


# Audits

_TYPES = {"x": "amplitude", "y": "amplitude", "z": "phase"}


@query(
    with_(
        AUCS,
        """, tr AS (SELECT f.label AS fold, a.channel, avg(a.auc) AS m FROM (SELECT DISTINCT label FROM auc) f JOIN auc a ON a.label <> f.label GROUP BY 1, 2),
tf AS (SELECT auc.channel, avg(CASE WHEN m >= 0.5 THEN auc ELSE 1 - auc END) AS t FROM auc JOIN tr ON fold = label AND tr.channel = auc.channel GROUP BY 1)
SELECT CASE WHEN channel = 'z' THEN 'phase' ELSE 'amplitude' END AS type, round(avg(t), 6) AS transfer, count(*) AS channels FROM tf GROUP BY 1""",
    )
)
def transfer_by_type(spark, sf_dir):
    t = learned.transfer_audit(_aucs(spark, sf_dir))
    types = t.select("channel").distinct().select("channel", F.element_at(F.create_map(*[F.lit(v) for kv in _TYPES.items() for v in kv]), F.col("channel")).alias("type"))
    return learned.type_means(t, types).withColumn("transfer", F.round("transfer", 6))


@query(with_(AUCS, ", st AS (SELECT f.label AS fold, a.channel, avg(greatest(a.auc, 1 - a.auc)) AS m FROM (SELECT DISTINCT label FROM auc) f JOIN auc a ON a.label <> f.label GROUP BY 1, 2), tp AS (SELECT fold, channel FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, channel) AS r FROM st) WHERE r <= 2) SELECT channel AS term FROM tp GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT fold) FROM tp)"))
def common_channels(spark, sf_dir):
    """Channels that are among the two best of every fold."""
    auc = _aucs(spark, sf_dir)
    folds = auc.select(F.col(S).alias("fold")).distinct()
    m = auc.join(folds, F.col(S) != F.col("fold")).groupBy("fold", "channel").agg(F.avg(F.greatest("auc", 1 - F.col("auc"))).alias("m"))
    best = m.withColumn("_r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("m"), "channel"))).filter("_r <= 2")
    return learned.common_terms(best.select("fold", F.col("channel").alias("term")), folds.count())


@query(with_(VOTES, "SELECT channel, count(*) AS uses FROM st WHERE k % 4 = 0 GROUP BY channel"))
def channel_usage(spark, sf_dir):
    pool = learned.stumps(_channels(spark, sf_dir), CH)
    return learned.channel_usage(pool, pool.filter("k % 4 = 0").select("k"))


def _term_sql(c: str, d: str | None = None) -> dict[str, str]:
    if d is None:
        return {f"sinlog({c})": f"sin(ln(abs({c}) + 1e-6::DOUBLE))", f"thr({c})": f"1.0::DOUBLE / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, 4.0::DOUBLE * {c}))))"}
    return {f"interf({c},{d})": f"cos({c} - {d})", f"reso({c},{d})": f"exp(-(({c} - {d}) * ({c} - {d})))"}


_TERM_SQL = {k: v for c in CH for k, v in _term_sql(c).items()} | {k: v for i, c in enumerate(CH) for d in CH[i + 1 :] for k, v in _term_sql(c, d).items()}
_ZNODES = NODES + ", zn AS (SELECT label, node_id, CAST(node_id % 3 = 0 AS INTEGER) AS y01, " + ", ".join(f"{_z(c)} AS {c}" for c in CH) + " FROM nodes WINDOW w AS (PARTITION BY label)), tl AS (" + " UNION ALL ".join(f"SELECT label, '{k}' AS channel, y01 AS y, round({v}, 9) AS score FROM zn" for k, v in _TERM_SQL.items()) + ")"


@query(with_(_ZNODES, f", ta AS ({_auc_sql('tl', 'label, channel')}) SELECT channel, round(avg(greatest(auc, 1 - auc)), 6) AS strength FROM ta GROUP BY channel ORDER BY avg(greatest(auc, 1 - auc)) DESC, channel LIMIT 5"))
def primitive_terms(spark, sf_dir):
    """Physics primitives over one or two standardised channels, the five that tell labels best on average."""
    x = features.zscore(_channels(spark, sf_dir), CH)
    terms = learned.pair_terms(CH)
    wide = x.select(S, "node_id", "y01", *[F.round(v, 9).alias(k) for k, v in terms.items()])
    return learned.lean_top(learned.channel_auc(wide, list(terms)), 5).withColumn("strength", F.round("strength", 6))


@query(with_(_ZNODES, "SELECT a.node_id, b.node_id AS landmark, round(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 3.0::DOUBLE), 6) AS k FROM zn a JOIN zn b ON a.label = b.label AND b.node_id % 25 = 0"))
def rbf_gram(spark, sf_dir):
    """Kernel values of every point against its structure's landmarks."""
    x = features.zscore(_channels(spark, sf_dir), CH)

    def run(key, pdf):
        own = pdf[pdf["node_id"] % 25 == 0]
        k = learned.rbf(pdf[CH].to_numpy(float), own[CH].to_numpy(float), 1.0 / len(CH))
        return pd.DataFrame({"node_id": np.repeat(pdf["node_id"].to_numpy(), len(own)), "landmark": np.tile(own["node_id"].to_numpy(), len(pdf)), "k": k.ravel()})

    return x.groupBy(S).applyInPandas(run, "node_id long, landmark long, k double").withColumn("k", F.round("k", 6))


# All subsets of the pool: bits of a number choose among the 18 stumps.
_SUBSETS = VOTES + """, q AS (SELECT a.k AS a, b.k AS b, CASE WHEN a.k = b.k THEN sum(a.h * b.h) / 324.0::DOUBLE - 2.0::DOUBLE / 18.0 * sum(a.h * (2.0::DOUBLE * a.y01 - 1.0)) + 0.04 ELSE 2.0::DOUBLE / 324.0 * sum(a.h * b.h) END AS q FROM h a JOIN h b USING (node_id) GROUP BY 1, 2),
lo AS (SELECT m, sum(CASE WHEN (m >> a) & 1 = 1 AND (m >> b) & 1 = 1 THEN q ELSE 0 END) AS e FROM range(512) t(m), q WHERE a < 9 AND b < 9 GROUP BY m),
hi AS (SELECT m, sum(CASE WHEN (m >> (a - 9)) & 1 = 1 AND (m >> (b - 9)) & 1 = 1 THEN q ELSE 0 END) AS e FROM range(512) t(m), q WHERE a >= 9 AND b >= 9 GROUP BY m),
cr AS (SELECT m AS lm, b, sum(CASE WHEN (m >> a) & 1 = 1 THEN 2 * q ELSE 0 END) AS e FROM range(512) t(m), q WHERE a < 9 AND b >= 9 GROUP BY ALL),
xx AS (SELECT lm, hi.m AS hm, sum(CASE WHEN (hi.m >> (b - 9)) & 1 = 1 THEN cr.e ELSE 0 END) AS e FROM cr, hi GROUP BY ALL)"""


@query(with_(_SUBSETS, "SELECT round(min(lo.e + hi.e + xx.e), 5) AS energy FROM xx JOIN lo ON lo.m = lm JOIN hi ON hi.m = hm"))
def qboost_optimum(spark, sf_dir):
    """The least energy that annealing finds, against all subsets of the pool."""
    x = _channels(spark, sf_dir)
    runs = learned.anneal(learned.qubo(x, CH, learned.stumps(x, CH)), 12, 6000)
    return runs.agg(F.round(F.min("energy"), 5).alias("energy"))


@query("SELECT 90::BIGINT AS terms, 0.0::DOUBLE AS gradient, true AS above")
def stlsq_library(spark, sf_dir):
    """A sparse law over all 90 terms of the twelve spectral channels: at the terms that stay the ridge loss has no slope,
    and none of them lies below the threshold."""
    n, e = structures(spark, sf_dir)
    bank = features.zscore(features.feature_bank(n, e, "bank12"), BANK12)
    lib = features.library(bank, BANK12)
    terms = [c for c in lib.columns if c not in (S, "node_id")]
    x = cut_lineage(lib.join(n.select(S, "node_id", (F.col("node_id") % 3 == 0).cast("int").alias("y01")), [S, "node_id"]))
    c = learned.sparse_law(x, terms, 0.03)
    kept = {k: v for k, v in c.items() if v}
    mean = x.agg(F.avg("y01").alias("m"))
    r = x.crossJoin(F.broadcast(mean)).withColumn("_r", learned.linear(kept) - (F.col("y01") - F.col("m")))  # one row
    slopes = r.agg(*[F.abs(F.sum(F.col(f"`{k}`") * F.col("_r")) + F.lit(v)).alias(f"s{i}") for i, (k, v) in enumerate(kept.items())])
    worst = F.greatest(*[F.col(f"s{i}") for i in range(len(kept))], F.lit(0.0))
    return slopes.select(F.lit(len(terms)).cast("long").alias("terms"), (F.round(worst, 5) + 0.0).alias("gradient"), F.lit(bool(kept) and min(map(abs, kept.values())) >= 0.03).alias("above"))


# Noise

_PS = (0.0, 0.25, 0.5, 0.75, 1.0)
_EXP, _LAST = exponentials("lap", 20.0, 16)
_DEPHASED = LOGF_LAP + _EXP + f", dp AS (SELECT n.label, n.node_id, p, CAST(n.node_id % 3 = 0 AS INTEGER) AS y, round(coalesce(sum((1 - p) * m.f + p * m.g) FILTER (WHERE d >= 3), 0.0), 9) AS score FROM nodes n CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS p) LEFT JOIN {_LAST} m ON m.i = n.node_id LEFT JOIN gdist g ON g.i = m.i AND g.j = m.j GROUP BY ALL)"


def _dephased(spark, sf_dir) -> DataFrame:
    def run(s):
        return {"node_id": list(s.ids) * len(_PS), "loss": [p for p in _PS for _ in s.ids], "score": [x for p in _PS for x in s.band(spectral.dephased(*s.eig("logf", 1.0), p))]}

    x = spectral.per_structure(*structures(spark, sf_dir), run, "node_id long, loss double, score double")
    x = x.withColumn("score", F.round("score", 9)).withColumn("y01", (F.col("node_id") % 3 == 0).cast("int"))
    return scoring.roc_auc(x, "loss").select(S, F.col("loss").alias("p"), F.round("auc", 6).alias("auc"))


@query(with_(_DEPHASED, f"SELECT CAST(label AS VARCHAR) AS structure_id, p, round(auc, 6) AS auc FROM ({_auc_sql('dp', 'label, p')})"))
def dephasing_curve(spark, sf_dir):
    """AUC of the banded metric as phases are lost."""
    return _dephased(spark, sf_dir)


@query(with_(_DEPHASED, f"SELECT CAST(label AS VARCHAR) AS structure_id, printf('p%.2f', p) AS level, round(auc, 6) AS auc FROM ({_auc_sql('dp', 'label, p')})"))
def sink_noise(spark, sf_dir):
    """The curve as one JSON document for each structure, written and read again."""
    path = f"{shared_folder(spark)}/noise-{uuid.uuid4().hex}"
    curve = _dephased(spark, sf_dir).select(S, F.format_string("p%.2f", "p").alias("level"), "auc")
    sinks.curve_json(curve).select("json").write.text(path)
    doc = spark.read.schema("structure_id string, dephasing map<string,double>").json(path)
    return doc.select(S, F.explode("dephasing").alias("level", "auc"))


# Coarse graphs. Runs of three along a path make a coarse path with one contact between neighbours.


@query(with_(PATH, ", cm AS (SELECT label, ceil(n / 3.0::DOUBLE)::BIGINT AS m FROM pn GROUP BY label, n), fw AS (SELECT label, k, w / min(w) OVER (PARTITION BY label) AS w FROM md WHERE k BETWEEN 1 AND 6), cw AS (SELECT label, k, w / min(w) OVER (PARTITION BY label) AS w FROM (SELECT label, k, 2.0::DOUBLE - 2.0::DOUBLE * cos(pi() * k / m) AS w FROM cm, range(1, 7) t(k) WHERE k < m)) SELECT CAST(label AS VARCHAR) AS structure_id, round(avg(abs(c.w - f.w) / (f.w + 1e-9)), 5) AS mean_error FROM fw f JOIN cw c USING (label, k) GROUP BY label"))
def path_preservation(spark, sf_dir):
    """How near the low eigenvalues of a coarse graph come to those of the fine one, both in units of their first."""
    n, e = paths(spark, sf_dir)
    at = F.row_number().over(Window.partitionBy(S).orderBy("node_id")) - 1
    c = n.select(S, "node_id", F.floor(at / 3).cast("long").alias("cluster_id"))
    return experiments.preservation(n, e, c).select(S, F.round("mean_error", 5).alias("mean_error"))


@query()
def retention(spark, sf_dir):
    """The detector on graphs of a half, a third and a fifth of the nodes: AUC of super-nodes and of their residues, what is
    kept of the full AUC, the spectral error, and how much cheaper the eigensystem is."""
    return experiments.retention(*_thirds(spark, sf_dir), lambda n, e, ratio: coarse_clusters(n, e, ratio))


@query()
def coordinate_noise(spark, sf_dir):
    """Mean and spread of the detector's AUC under jitter of the coordinates, eight draws for each width."""
    return experiments.jitter(embedding_nodes(spark, sf_dir, by_label=True).withColumn("y01", (F.col("node_id") % 3 == 0).cast("int")), 20.0)


# The routed answer and hit-list variants

_I, _ILAST = exponentials("lap", 20.0, 16)
_ROUTED = (
    LOGF_LAP.replace("lap AS MATERIALIZED", "llap AS MATERIALIZED")
    + _I.replace("FROM lap)", "FROM llap)")
    + _GNM[_GNM.index(", lap AS MATERIALIZED") :]
    + f""", far AS (SELECT n.node_id, coalesce(sum(m.f) FILTER (WHERE d BETWEEN 3 AND 8), 0.0) AS score FROM nodes n LEFT JOIN {_ILAST} m ON m.i = n.node_id LEFT JOIN gdist g ON g.i = m.i AND g.j = m.j GROUP BY 1),
near_ AS (SELECT n.node_id, abs(coalesce(sum(m.v) FILTER (WHERE o.is_active), 0.0)) AS score FROM nodes n LEFT JOIN gi m ON m.i = n.node_id LEFT JOIN nodes o ON o.node_id = m.j GROUP BY 1),
det AS (SELECT label, node_id, 'interference' AS detector, far.score FROM far JOIN nodes USING (node_id) UNION ALL SELECT label, node_id, 'gnm_active', near_.score FROM near_ JOIN nodes USING (node_id)),
kk AS (SELECT label, detector, CASE WHEN stddev_pop(score) < 1e-12 THEN 0.0 ELSE kurtosis_pop(score) + 3.0 END AS k FROM det GROUP BY 1, 2),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {significant_sql('k')} DESC, detector) AS r FROM kk) WHERE r = 1),
ho AS (SELECT det.label, detector, node_id, score, row_number() OVER (PARTITION BY det.label ORDER BY {significant_sql('score')} DESC, node_id) AS pos FROM det JOIN bb USING (label, detector) JOIN nodes USING (node_id) WHERE NOT is_active)"""
)


# The flagship: the more decisive of two detectors, and the top five of each structure.
SQL["routed_hits"] = with_(_ROUTED, "SELECT CAST(label AS VARCHAR) AS structure_id, detector, CASE WHEN detector LIKE 'gnm%' OR detector LIKE '%active%' THEN 'proximal' ELSE 'distal' END AS regime, node_id, CAST(pos AS INTEGER) AS pos, round(score, 6) + 0.0 AS score FROM ho WHERE pos <= 5")


@query()
def predict_variants(spark, sf_dir):
    """Four hit lists of each structure: by precision, of the most decisive detector, best of all and by reciprocal ranks;
    written by structure and variant, as they are read back."""
    path = f"{shared_folder(spark)}/variants-{uuid.uuid4().hex}"
    experiments.predict_variants(*_thirds(spark, sf_dir)).write.partitionBy(S, "variant").json(path)
    return spark.read.schema("pos int, node_id long, score double, structure_id string, variant string").json(path).select(S, "variant", "pos", "node_id", F.round("score", 5).alias("score"))


@query()
def phase_margin(spark, sf_dir):
    """Boosted trees on the curated channels with and without phases: AUC of each structure left out, by ridge sums."""
    n, e = _thirds(spark, sf_dir)
    cols = features.channel_names("bank23")
    bank = features.zscore(features.feature_bank(n, e, "bank23"), cols).join(n.select(S, "node_id", "y01"), [S, "node_id"])
    bank = cut_lineage(bank.select(S, "node_id", "y01", *[f"`{c}`" for c in cols]))
    out = None
    for name, keep in (("curated", experiments.curated(cols)), ("amplitude", experiments.amplitude(cols))):
        one = scoring.roc_auc(learned.ridge_transfer(bank, keep)).select(S, F.lit(name).alias("channels"), F.round("auc", 4).alias("auc"))
        out = one if out is None else out.unionByName(one)
    return out


# The first principal component. SQL squares the covariance, scaled by its trace, until only the leading projector is left.
_SQUARINGS = 14


def _leading_sql() -> str:
    cov = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_pop({a}, {b}) AS v FROM nodes" for i, a in enumerate(CH) for j, b in enumerate(CH))
    out = f", pc AS ({cov}), q0 AS (SELECT i, j, v / (SELECT sum(v) FROM pc WHERE i = j) AS v FROM pc)"
    for k in range(_SQUARINGS):
        out += f", s{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM q{k} a JOIN q{k} b ON a.j = b.i GROUP BY 1, 2), q{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM s{k} WHERE i = j) AS v FROM s{k})"
    return out + f""", xc AS (SELECT node_id, unnest([0, 1, 2]) AS i, unnest([x - avg(x) OVER (), y - avg(y) OVER (), z - avg(z) OVER ()]) AS v FROM nodes),
sp AS (SELECT sqrt(sum(p.v * c.v)) AS s FROM q{_SQUARINGS} p JOIN pc c ON c.i = p.j AND c.j = p.i),
pq AS (SELECT a.node_id, sqrt(greatest(0.0, sum(a.v * p.v * b.v))) AS d FROM xc a JOIN q{_SQUARINGS} p ON p.i = a.i JOIN xc b ON b.node_id = a.node_id AND b.i = p.j GROUP BY 1)"""


@query(with_(NODES + _leading_sql(), "SELECT node_id, round(tanh(d / (s + 1e-9)), 5) + 0.0 AS pc0 FROM pq, sp"))
def principal_channel(spark, sf_dir):
    """The first principal component of all points, squashed by its spread; its sign is arbitrary and left out."""
    x = embedding_nodes(spark, sf_dir)
    return learned.principal(x, x, CH, 2).select("node_id", (F.round(F.abs("pc0"), 5) + 0.0).alias("pc0"))
