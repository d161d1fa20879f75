"""Queries of blended models: logistic, kernel and the best single channel, each trained on structures left in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import significant_sql
from ..functions.lineage import cut_lineage
from ..operators import features, learned, scoring
from ..operators.graph import S
from .catalogue import CH, _thirds, query, with_
from .laws import _NEWTON, _SHARES, BANDS, ZS, _bands, gauss_sql, standard
from .studies import _auc_sql

# Each fold's best channel: SQL takes all rows of the other folds for each. A fold is a structure, or a group of them, named before the dot.
_CHANNELS = """, lc AS (""" + " UNION ALL ".join(f"SELECT label, node_id, y01 AS y, '{c}' AS channel, {c} AS raw, {significant_sql(c)} AS score FROM zs" for c in CH) + ")"
_BEST = f"""
pa AS ({_auc_sql('po', 'fold, channel')}), pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {significant_sql('greatest(auc, 1 - auc)')} DESC, channel) AS r FROM pa) WHERE r = 1)"""
_EACH = _CHANNELS + ",\npo AS (SELECT f.label AS fold, lc.channel, y, score FROM (SELECT DISTINCT label FROM zs) f JOIN lc ON lc.label <> f.label)," + _BEST
_POOLED = _CHANNELS + ",\npo AS (SELECT fold, lc.channel, y, score FROM (SELECT DISTINCT split_part(label, '.', 1) AS fold FROM zs) f JOIN lc ON split_part(lc.label, '.', 1) <> fold)," + _BEST
_PCT = f"(row_number() OVER (PARTITION BY label ORDER BY {significant_sql('score')}, node_id) - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY label) - 1)"
_LINEAR = f"""{_NEWTON}{_POOLED},
lg AS (SELECT u.label, u.node_id, any_value(u.y)::INTEGER AS y, sum(u.v * c.v) AS score FROM u0 u JOIN w{learned.NEWTON} c ON c.label = u.label AND c.i = u.i GROUP BY 1, 2),
sg AS (SELECT label, node_id, y, CASE WHEN auc >= 0.5 THEN raw ELSE -raw END AS score FROM lc JOIN pb ON fold = split_part(label, '.', 1) AND pb.channel = lc.channel),
mx AS (SELECT label, node_id, y, avg(pct) AS score FROM (SELECT label, node_id, y, {_PCT} AS pct FROM lg UNION ALL SELECT label, node_id, y, {_PCT} FROM sg) GROUP BY ALL),
al AS (SELECT label, y, model, {significant_sql('score')} AS score FROM (SELECT label, y, 'logistic' AS model, score FROM lg UNION ALL SELECT label, y, 'single', score FROM sg UNION ALL SELECT label, y, 'linear', score FROM mx))"""


@query(with_(ZS + _EACH, "SELECT CAST(fold AS VARCHAR) AS fold, channel, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign, round(greatest(auc, 1 - auc), 6) AS strength FROM pb"))
def best_channel_pooled(spark, sf_dir):
    """The channel and sign that tell labels best in all rows of the other structures taken together."""
    return learned.best_channel_pooled(standard(spark, sf_dir), CH, folds_by=learned.EACH).withColumn("strength", F.round("strength", 6))


@query(with_(_LINEAR, f"SELECT CAST(label AS VARCHAR) AS structure_id, model, round(auc, 6) AS auc FROM ({_auc_sql('al', 'label, model')})"))
def blend_linear(spark, sf_dir):
    """AUC of the logistic model, of the best single channel and of the mean of their rank percentages, structure by structure."""
    return scoring.roc_auc(learned.blended(standard(spark, sf_dir), CH), "model").select(S, "model", F.round("auc", 6).alias("auc"))


@query()
def blend_learned(spark, sf_dir):
    """The whole blend on the fourteen spectral channels, standardised within structures: the kernel sees those of interference only."""
    n, e = _thirds(spark, sf_dir)
    cols = features.channel_names("bank14")
    x = features.zscore(features.feature_bank(n, e, "bank14"), cols).join(n.select(S, "node_id", "y01"), [S, "node_id"])
    out = learned.blended(cut_lineage(x), cols, [c for c in cols if c.startswith("interf")])
    return scoring.roc_auc(out, "model").select(S, "model", F.round("auc", 4).alias("auc"))


_FITS = (
    _SHARES
    + ", pl AS (SELECT a.label, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM pz a JOIN pz b USING (label, node_id) GROUP BY a.label, a.i, b.i"
    + f" UNION ALL SELECT label, i, {BANDS}, sum(v * (y - m)) FROM pz JOIN (SELECT label, avg(CAST(node_id % 3 = 0 AS INTEGER)) AS m FROM nodes GROUP BY label) USING (label) GROUP BY label, i)"
    + gauss_sql("ol", "pl", BANDS)
    + ", ou AS (SELECT label, i, v / (sqrt(sum(v * v) OVER (PARTITION BY label)) + 1e-12) AS v FROM ol)"
)


@query(with_(_FITS, "SELECT CAST(a.label AS VARCHAR) AS structure_id, CAST(b.label AS VARCHAR) AS other, round(sum(a.v * b.v), 5) + 0.0 AS cosine FROM ou a JOIN ou b ON a.i = b.i AND CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR) GROUP BY 1, 2"))
def path_agreement(spark, sf_dir):
    """Cosines between the structures' ridge operators on the shares of frequency bands, on paths."""
    return learned.operator_agreement(learned.operator_fits(*_bands(spark, sf_dir), 1.0)).select(S, "other", (F.round("cosine", 5) + 0.0).alias("cosine"))
