"""Queries of laws: symbolic searches, sparse laws and spectral transfer functions, each tested on structures left out."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import significant_sql
from ..functions.lineage import cut_lineage
from ..operators import features, laws, learned, ranking, scoring, spectral
from ..operators.graph import S
from .catalogue import CH, NODES, TERMS, _channels, _thirds, _z, query, structures, with_
from .spectra import _BINS, PATH, paths
from .studies import _auc_sql

ZS = NODES + ", zs AS (SELECT label, node_id, CAST(node_id % 3 = 0 AS INTEGER) AS y01, " + ", ".join(f"{_z(c)} AS {c}" for c in CH) + " FROM nodes WINDOW w AS (PARTITION BY label))"


def standard(spark, sf_dir) -> DataFrame:
    return features.zscore(_channels(spark, sf_dir), CH)


# Trees. A fixed population, by hashed draws, is scored by both sides.

FIXED = [laws.first_tree(random.Random(f"fixed:{k}"), s, CH) for s, n in ((laws.LAW_SEARCH, 16), (laws.GENERIC_SEARCH, 8)) for k in range(n)]
_TREES = ZS + ", tv AS (" + " UNION ALL ".join(f"SELECT label, {k} AS tree, y01 AS y, {significant_sql('v')} AS score FROM (SELECT label, y01, {laws.to_sql(t)} AS v FROM zs)" for k, t in enumerate(FIXED)) + ")"


@query(with_(_TREES, f"SELECT CAST(label AS VARCHAR) AS structure_id, tree, round(auc, 6) AS auc FROM ({_auc_sql('tv', 'label, tree')})"))
def law_population(spark, sf_dir):
    """AUC of every tree of a fixed population on every structure."""
    x = standard(spark, sf_dir)
    wide = x.select(S, "node_id", "y01", *[laws.column(t).alias(str(k)) for k, t in enumerate(FIXED)])
    return learned.channel_auc(wide, [str(k) for k in range(len(FIXED))]).select(S, F.col("channel").cast("int").alias("tree"), F.round("auc", 6).alias("auc"))


_FIT = ZS + ", fx AS (" + " UNION ALL ".join(f"SELECT label, {k} AS tree, y01, {laws.to_sql(t)} AS v FROM zs" for k, t in enumerate(FIXED)) + ")"


@query(
    with_(
        _FIT,
        """, pr AS (SELECT DISTINCT label FROM zs), er AS (SELECT p.label, tree, sum(abs(v - y01)) FILTER (WHERE y01 = 0) AS e0, sum(abs(v - y01)) FILTER (WHERE y01 = 1) AS e1, count(*) FILTER (WHERE y01 = 0)::DOUBLE AS n0, count(*) FILTER (WHERE y01 = 1)::DOUBLE AS n1 FROM pr p JOIN fx ON fx.label <> p.label GROUP BY 1, 2)
SELECT CAST(label AS VARCHAR) AS structure_id, tree, round((e0 + greatest(1, n0) / greatest(1, n1) * e1) / (n0 + greatest(1, n0) / greatest(1, n1) * n1), 6) AS error FROM er""",
    )
)
def law_errors(spark, sf_dir):
    """Mean absolute error of the same trees on all structures but each one, by the search's own pass over the rows."""
    x = standard(spark, sf_dir).withColumn("fold", F.col(S))
    trees = x.select("fold").distinct().select("fold", F.posexplode(F.array(*[F.array(*[F.lit(v) for v in t]) for t in FIXED])).alias("place", "tokens"))
    search = laws.Search(tuple(laws.FUNCTIONS), metric="mae", parsimony=0.0)
    sample = x.limit(0).toPandas()
    return laws.scored(x, CH, trees, sample, search).select(F.col("fold").alias(S), F.col("place").alias("tree"), F.round(-F.col("fitness"), 6).alias("error"))


PLANTED = ["reso", "mul", "x", "y", "thr", "z"]


@query(with_(ZS + f", pl AS (SELECT label, node_id, {laws.to_sql(PLANTED)} AS v FROM zs), yy AS (SELECT label, v AS score, CAST(v > 0.5 AS INTEGER) AS y FROM pl)", f"SELECT CAST(label AS VARCHAR) AS structure_id, round(auc, 2) AS auc FROM ({_auc_sql('yy')}) WHERE auc IS NOT NULL"))
def planted_law(spark, sf_dir):
    """Labels follow a law of depth 3, which the search is not told: what it finds orders every structure as that law does."""
    x = standard(spark, sf_dir).withColumn("y01", (laws.column(PLANTED) > 0.5).cast("int"))
    found = laws.search(x, CH, replace(laws.LAW_SEARCH, population=600), hold_out=False)
    return scoring.roc_auc(laws.applied(x, found)).filter("auc IS NOT NULL").select(S, F.round("auc", 2).alias("auc"))


def held_out_laws(x: DataFrame, cols: list[str], s: laws.Search) -> DataFrame:
    """(structure_id, law, auc): each structure under the law that was found without its fold."""
    x = cut_lineage(x)
    scored = laws.applied(x, laws.search(x, cols, s))
    return scoring.roc_auc(scored).join(scored.groupBy(S).agg(F.first("law").alias("law")), S).select(S, "law", F.round("auc", 4).alias("auc"))


#: What ten folds are searched with, side by side.
FOLDS = {"population": 200, "generations": 8}


def _ranked_bank(spark, sf_dir, bank: str) -> tuple[DataFrame, list[str]]:
    n, e = _thirds(spark, sf_dir)
    cols = features.channel_names(bank)
    return features.rank_gauss(features.feature_bank(n, e, bank), cols).join(n.select(S, "node_id", "y01"), [S, "node_id"]), cols


@query()
def law_transfer(spark, sf_dir):
    """Physics trees over all 23 channels, amplitudes and phases, for the AUC of structures left out."""
    return held_out_laws(*_ranked_bank(spark, sf_dir, "bank23"), replace(laws.LAW_SEARCH, **FOLDS))


@query()
def generic_law_transfer(spark, sf_dir):
    """Trees of plain arithmetic over 13 channels, for their mean absolute error, on structures left out."""
    return held_out_laws(*_ranked_bank(spark, sf_dir, "bank13"), replace(laws.GENERIC_SEARCH, **FOLDS))


# Linear systems in SQL: Gauss-Jordan elimination of (label, i, j, v), the right side in column d. No pivoting: the systems
# are positive definite.


def gauss_sql(name: str, table: str, d: int) -> str:
    """Tables ending in `name` (label, i, v): the solution of each label's system of d unknowns."""
    parts, last = [], table
    for k in range(d):
        parts.append(
            f"{name}_{k} AS MATERIALIZED (SELECT a.label, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / q.v ELSE a.v - c.v * p.v / q.v END AS v FROM {last} a JOIN {last} p ON p.label = a.label AND p.i = {k} AND p.j = a.j "
            f"JOIN {last} c ON c.label = a.label AND c.i = a.i AND c.j = {k} JOIN {last} q ON q.label = a.label AND q.i = {k} AND q.j = {k})"
        )
        last = f"{name}_{k}"
    return ", " + ",\n".join(parts) + f", {name} AS (SELECT label, i, v FROM {last} WHERE j = {d})"


_T = list(TERMS)
_LIB = NODES + ", l0 AS (SELECT label, node_id, CAST(node_id % 3 = 0 AS INTEGER)::DOUBLE AS y, " + ", ".join(f"{_z(v)} AS t{k}" for k, v in enumerate(TERMS.values())) + f" FROM nodes WINDOW w AS (PARTITION BY label)), ll AS (SELECT label, node_id, y, unnest({list(range(len(_T)))}) AS i, unnest([{', '.join(f't{k}' for k in range(len(_T)))}]) AS v FROM l0)"
_LIB += """, g1 AS (SELECT a.label, a.i, b.i AS j, sum(a.v * b.v) AS v FROM ll a JOIN ll b USING (node_id) GROUP BY ALL),
m1 AS (SELECT label, i, sum(v * y) AS vy, sum(v) AS v1 FROM ll GROUP BY ALL), s1 AS (SELECT label, sum(y) AS sy, count(*)::DOUBLE AS n FROM l0 GROUP BY 1),
fl AS (SELECT DISTINCT label FROM nodes),
gf AS (SELECT f.label, i, j, sum(v) AS v FROM fl f JOIN g1 ON g1.label <> f.label GROUP BY ALL),
mf AS (SELECT f.label, i, sum(vy) AS vy, sum(v1) AS v1 FROM fl f JOIN m1 ON m1.label <> f.label GROUP BY ALL), sf AS (SELECT f.label, sum(sy) AS sy, sum(n) AS n FROM fl f JOIN s1 ON s1.label <> f.label GROUP BY 1)"""
_THRESHOLD = 0.012
_STEPS = 4


def _sparse_sql() -> str:
    d = len(_T)
    out = ", k0 AS (SELECT label, i, true AS stays FROM mf)"
    for r in range(_STEPS + 1):
        out += f""", a{r} AS (SELECT g.label, g.i, g.j, CASE WHEN p.stays AND q.stays THEN g.v + CASE WHEN g.i = g.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN g.i = g.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM gf g JOIN k{r} p ON p.label = g.label AND p.i = g.i JOIN k{r} q ON q.label = g.label AND q.i = g.j
  UNION ALL SELECT m.label, m.i, {d}, CASE WHEN stays THEN vy - sy / n * v1 ELSE 0.0::DOUBLE END FROM mf m JOIN sf USING (label) JOIN k{r} USING (label, i)){gauss_sql(f'c{r}', f'a{r}', d)}, k{r + 1} AS (SELECT c.label, c.i, stays AND abs(c.v) >= {_THRESHOLD}::DOUBLE AS stays FROM c{r} c JOIN k{r} USING (label, i))"""
    return out


_NAMES = "[" + ", ".join(f"'{t}'" for t in _T) + "]"
_SPARSE = _LIB + _sparse_sql()


def _sparse(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    x = features.library(_channels(spark, sf_dir), CH).join(_channels(spark, sf_dir).select(S, "node_id", "y01"), [S, "node_id"])
    return x, learned.sparse_solved(learned.others(learned.structure_sums(x, _T)), len(_T), _THRESHOLD, rounds=_STEPS)


@query(with_(_SPARSE, f"SELECT CAST(label AS VARCHAR) AS structure_id, {_NAMES}[i + 1] AS term, round(v, 6) + 0.0 AS coefficient FROM c{_STEPS} JOIN k{_STEPS} USING (label, i) WHERE stays"))
def held_out_law_terms(spark, sf_dir):
    """The terms of the sparse law that was fitted without each structure."""
    _, c = _sparse(spark, sf_dir)
    one = c.select(S, F.posexplode("c").alias("k", "coefficient")).filter("coefficient <> 0")
    return one.select(S, F.get(F.array(*[F.lit(t) for t in _T]), F.col("k")).alias("term"), (F.round("coefficient", 6) + 0.0).alias("coefficient"))


@query(with_(_SPARSE, f"SELECT {_NAMES}[i + 1] AS term FROM k{_STEPS} GROUP BY i HAVING bool_and(stays)"))
def held_out_law_common(spark, sf_dir):
    """Terms that every fold's law holds."""
    terms = held_out_law_terms(spark, sf_dir).select(F.col(S).alias("fold"), "term")
    return learned.common_terms(terms, _channels(spark, sf_dir).select(S).distinct().count())


@query(with_(_SPARSE, f", lv AS (SELECT ll.label, node_id, y, {significant_sql('s')} AS score FROM (SELECT ll.label, ll.node_id, ll.y, sum(ll.v * CASE WHEN stays THEN c.v ELSE 0 END) AS s FROM ll JOIN c{_STEPS} c USING (label, i) JOIN k{_STEPS} USING (label, i) GROUP BY ALL) ll) SELECT CAST(label AS VARCHAR) AS structure_id, round(auc, 6) AS auc FROM ({_auc_sql('lv')})"))
def held_out_law_auc(spark, sf_dir):
    """AUC of each structure under the sparse law of the others."""
    x, c = _sparse(spark, sf_dir)
    return scoring.roc_auc(learned.applied(x, _T, c)).select(S, F.round("auc", 6).alias("auc"))


# The spectral transfer function: what weight the labels of all structures give to each band of frequencies. On paths the
# shares of bands are sums over known modes.

BANDS = 20
_SHARES = (
    PATH
    + _BINS
    + f""", sb AS (SELECT p.label, p.node_id, CAST(p.node_id % 3 = 0 AS INTEGER)::DOUBLE AS y, t.bin, coalesce(sum(v * v), 0.0) AS s FROM pn p CROSS JOIN range({BANDS}) t(bin) LEFT JOIN bn ON bn.node_id = p.node_id AND bn.bin = t.bin GROUP BY ALL),
pz AS (SELECT label, node_id, y, bin AS i, (s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-9) AS v FROM sb WINDOW w AS (PARTITION BY label, bin)),
pg AS (SELECT 0 AS label, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM pz a JOIN pz b USING (node_id) GROUP BY a.i, b.i UNION ALL SELECT 0, i, {BANDS}, sum(v * (y - (SELECT avg(CAST(node_id % 3 = 0 AS INTEGER)) FROM nodes))) FROM pz GROUP BY i)"""
    + gauss_sql("gl", "pg", BANDS)
)
_GL_SCORES = _SHARES + f", gs AS (SELECT pz.label, node_id, y, {significant_sql('s')} AS score FROM (SELECT pz.label, node_id, y, sum(pz.v * gl.v) AS s FROM pz JOIN gl ON gl.i = pz.i GROUP BY ALL) pz)"


def _bands(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    cols = [f"b{k}" for k in range(BANDS)]
    n, e = paths(spark, sf_dir)
    p = spectral.per_structure(n, e, lambda s: {"node_id": s.ids} | dict(zip(cols, spectral.participation(*s.eig()).T, strict=True)), "node_id long, " + ", ".join(f"{c} double" for c in cols))
    return features.zscore(p, cols).join(n.select(S, "node_id", (F.col("node_id") % 3 == 0).cast("int").alias("y01")), [S, "node_id"]), cols


@query(with_(_SHARES, "SELECT i::INTEGER AS band, round(v, 6) + 0.0 AS g FROM gl"))
def transfer_function(spark, sf_dir):
    """g of each band of frequencies, from the sums of all structures."""
    g = learned.ridge(*_bands(spark, sf_dir))
    return spark.createDataFrame([(k, v) for k, v in enumerate(g.values())], "band int, g double").select("band", (F.round("g", 6) + 0.0).alias("g"))


@query(with_(_GL_SCORES, "SELECT structure_id, node_id, pos, score FROM (SELECT CAST(label AS VARCHAR) AS structure_id, node_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, node_id)::INTEGER AS pos, round(score, 6) + 0.0 AS score FROM gs) WHERE pos <= 5"))
def transfer_function_hits(spark, sf_dir):
    """The five nodes of each structure that the transfer function weighs most."""
    x, cols = _bands(spark, sf_dir)
    x = cut_lineage(x)
    scores = x.select(S, "node_id", learned.linear(learned.ridge(x, cols)).alias("score"))
    return ranking.finalize(scores).filter("pos <= 5").select(S, "node_id", "pos", (F.round("score", 6) + 0.0).alias("score"))


# Logistic models: SQL takes the same Newton steps, with elimination for each.


def _newton_sql() -> str:
    out = ", u0 AS (SELECT label, node_id, y01::DOUBLE AS y, unnest([0, 1, 2, 3]) AS i, unnest([1.0::DOUBLE, x, y, z]) AS v FROM zs), ct AS (SELECT f.label, greatest(1, sum(1 - y01))::DOUBLE / greatest(1, sum(y01)) AS w FROM (SELECT DISTINCT label FROM zs) f JOIN zs ON zs.label <> f.label GROUP BY 1), w0 AS (SELECT label, i, 0.0::DOUBLE AS v FROM ct, range(4) t(i))"
    for k in range(learned.NEWTON):
        out += f""", p{k} AS (SELECT c.label, u.node_id, any_value(u.y) AS y, 1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, sum(u.v * c.v))))) AS p FROM w{k} c JOIN u0 u ON u.label <> c.label AND u.i = c.i GROUP BY 1, 2),
n{k} AS (SELECT p.label, a.i, b.i AS j, sum(CASE WHEN p.y = 1 THEN w ELSE 1 END * p * (1 - p) * a.v * b.v) + CASE WHEN a.i = b.i THEN {learned.DAMPED}::DOUBLE ELSE 0.0::DOUBLE END AS v FROM p{k} p JOIN ct USING (label) JOIN u0 a ON a.node_id = p.node_id JOIN u0 b ON b.node_id = p.node_id GROUP BY 1, 2, 3
  UNION ALL SELECT p.label, a.i, 4, sum(CASE WHEN p.y = 1 THEN w ELSE 1 END * (p - p.y) * a.v) + {learned.DAMPED}::DOUBLE * any_value(c.v) FROM p{k} p JOIN ct USING (label) JOIN u0 a ON a.node_id = p.node_id JOIN w{k} c ON c.label = p.label AND c.i = a.i GROUP BY 1, 2){gauss_sql(f'd{k}', f'n{k}', 4)},
w{k + 1} AS (SELECT label, i, c.v - d.v AS v FROM w{k} c JOIN d{k} d USING (label, i))"""
    return out


_NEWTON = ZS + _newton_sql()


@query(with_(_NEWTON, f"SELECT CAST(label AS VARCHAR) AS structure_id, i::INTEGER AS k, round(v, 5) + 0.0 AS c FROM w{learned.NEWTON}"))
def logistic_fit(spark, sf_dir):
    """Intercept and coefficients of the logistic model of all structures but each one."""
    return learned.logistic_fits(standard(spark, sf_dir), CH, folds_by=learned.EACH).select(F.col("fold").alias(S), F.posexplode("c").alias("k", "c")).select(S, "k", (F.round("c", 5) + 0.0).alias("c"))
