"""Queries of boosted trees: splits, leaves and held-out scores of the first trees, which SQL grows as well, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import significant_sql
from ..functions.lineage import cut_lineage
from ..operators import boosting
from ..operators.graph import S
from .catalogue import CH, NODES, _channels, query, with_

FIRST = boosting.Settings(trees=3, share=1.0)

_START = (
    NODES
    + f""", lg AS MATERIALIZED (SELECT node_id, c, v FROM (SELECT node_id, unnest([{", ".join(str(k) for k in range(len(CH)))}]) AS c, unnest([{", ".join(CH)}]) AS v FROM nodes)),
ed AS MATERIALIZED (SELECT DISTINCT c, unnest(q) AS e FROM (SELECT c, quantile_disc(v, [{", ".join(str(k / boosting.BINS) for k in range(1, boosting.BINS))}]) AS q FROM lg GROUP BY c)),
fl AS (SELECT node_id, split_part(label, '.', 1) AS fold, CAST(node_id % 3 = 0 AS INTEGER) AS y FROM nodes),
ct AS (SELECT a.fold AS f, count(*)::DOUBLE AS n, sum(b.y)::DOUBLE AS p FROM (SELECT DISTINCT fold FROM fl) a JOIN fl b ON a.fold <> b.fold GROUP BY 1),
hv AS (SELECT *, greatest(1, n - p) / greatest(1, p) AS h FROM ct),
s0 AS MATERIALIZED (SELECT f, node_id, y, fold = f AS own, CASE WHEN y = 1 THEN h ELSE 1.0 END AS w, h * p / (h * p + n - p) AS score FROM hv, fl)"""
)


def _best(name: str, rows: str, by: str) -> str:
    """The best split (by, c, e, gain) of the rows (by, node_id, w, g)."""
    gain = "lw * (tw - lw) / tw * pow(lg / lw - (tg - lg) / (tw - lw), 2)"
    return f""", {name} AS MATERIALIZED (SELECT {by}, c, e, gain FROM (SELECT {by}, c, e, {significant_sql(gain)} AS gain FROM
  (SELECT {by}, c, e, sum(w) AS tw, sum(g) AS tg, sum(w) FILTER (v <= e) AS lw, sum(g) FILTER (v <= e) AS lg FROM {rows} JOIN lg USING (node_id) JOIN ed USING (c) GROUP BY ALL)
  WHERE lw > 1e-9 AND tw - lw > 1e-9) WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, c, e) = 1)"""


def _tree(t: int) -> str:
    return (
        f", t{t} AS MATERIALIZED (SELECT f, node_id, w, w * (y - score) AS g FROM s{t} WHERE NOT own)"
        + _best(f"r{t}", f"t{t}", "f")
        + f", a{t} AS MATERIALIZED (SELECT s.f, s.node_id, coalesce(v > e, false)::INTEGER AS side FROM s{t} s LEFT JOIN r{t} r USING (f) LEFT JOIN lg l ON l.node_id = s.node_id AND l.c = r.c)"
        + _best(f"k{t}", f"(SELECT f, side, node_id, w, g FROM t{t} JOIN a{t} USING (f, node_id))", "f, side")
        + f""", b{t} AS MATERIALIZED (SELECT a.f, a.node_id, 2 * a.side + coalesce(v > e, false)::INTEGER AS leaf FROM a{t} a LEFT JOIN k{t} k USING (f, side) LEFT JOIN lg l ON l.node_id = a.node_id AND l.c = k.c),
l{t} AS MATERIALIZED (SELECT f, leaf, sum(g) / sum(w) AS value FROM t{t} JOIN b{t} USING (f, node_id) GROUP BY 1, 2),
s{t + 1} AS MATERIALIZED (SELECT s.* REPLACE (s.score + {FIRST.rate} * coalesce(value, 0.0) AS score) FROM s{t} s JOIN b{t} USING (f, node_id) LEFT JOIN l{t} USING (f, leaf))"""
    )


_GROWN = _START + "".join(_tree(t) for t in range(FIRST.trees))
_NAMES = "[" + ", ".join(f"'{c}'" for c in CH) + "][c + 1]"


def _first(spark, sf_dir):
    return boosting.boosted(cut_lineage(_channels(spark, sf_dir)), CH, FIRST)


@query(with_(_GROWN, " UNION ALL ".join(f"SELECT f AS fold, {t} AS tree, 0 AS node, {_NAMES} AS channel, round(e, 6) AS threshold, round(gain, 6) AS gain FROM r{t} UNION ALL SELECT f, {t}, 1 + side, {_NAMES}, round(e, 6), round(gain, 6) FROM k{t}" for t in range(FIRST.trees))))
def gbt_splits(spark, sf_dir):
    """Every split of the first trees of every fold, grown on all rows."""
    return _first(spark, sf_dir)[1].splits(spark).withColumn("threshold", F.round("threshold", 6)).withColumn("gain", F.round("gain", 6))


@query(with_(_GROWN, " UNION ALL ".join(f"SELECT f AS fold, {t} AS tree, leaf, round(value, 6) + 0.0 AS value FROM l{t}" for t in range(FIRST.trees))))
def gbt_leaves(spark, sf_dir):
    """Every leaf of these trees that holds a row; the others' value is zero."""
    return _first(spark, sf_dir)[1].leaves(spark).filter("value <> 0").withColumn("value", F.round("value", 6) + 0.0)


@query(with_(_GROWN, f"SELECT label AS structure_id, node_id, round(score, 6) AS score FROM s{FIRST.trees} JOIN nodes USING (node_id) WHERE own"))
def gbt_scores(spark, sf_dir):
    """Every point's score by the first trees of the other folds."""
    return _first(spark, sf_dir)[0].select(S, "node_id", F.round("score", 6).alias("score"))


@query()
def gbt_importance(spark, sf_dir):
    """Each channel's share of the gains of 50 trees of every fold, the rows drawn anew for each tree."""
    forest = boosting.boosted(cut_lineage(_channels(spark, sf_dir)), CH, boosting.Settings(trees=50))[1]
    return forest.importance(spark).withColumn("importance", F.round("importance", 6))
