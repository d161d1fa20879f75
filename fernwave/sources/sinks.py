"""Writers for what runs leave behind: leaderboards, hit lists, matrices and reports, all by Spark's own writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import S


def leaderboard(frames: list[DataFrame], first: tuple[str, ...] = ("exp", S)) -> DataFrame:
    """Rows of unequal columns as one table: the preferred columns, then the others by name."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    lead = [c for c in first if c in every.columns]
    return every.select(*lead, *sorted(c for c in every.columns if c not in lead))


def leaderboard_means(board: DataFrame) -> DataFrame:
    return board.groupBy("exp").agg(F.avg("roc_auc").alias("mean_auc"), F.sum("hit_5").alias("hits_5"))


def write_run(path: str, hits: DataFrame, board: DataFrame, matrix: DataFrame | None = None) -> None:
    hits.write.mode("overwrite").partitionBy(S).json(f"{path}/hits")
    board.write.mode("overwrite").option("header", True).csv(f"{path}/leaderboard")
    if matrix is not None:
        matrix.write.mode("overwrite").partitionBy(S).parquet(f"{path}/matrix")


def report_lines(board: DataFrame) -> DataFrame:
    """(structure_id, line): a bullet for each structure."""
    return board.select(S, F.format_string("- **%s**: AUC %.3f, top 5 hit %d", F.col(S), F.col("roc_auc"), F.col("hit_5")).alias("line"))


def submission_json(hits: DataFrame, stats: DataFrame, by: str = S) -> DataFrame:
    """(structure_id, json): a structure's statistics with its hits, in order, as one nested document."""
    rows = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in hits.columns if c not in (by, "pos")]))).alias("hits"))
    both = stats.join(rows, by, "left")
    return both.select(by, F.to_json(F.struct(*[c for c in both.columns])).alias("json"))


def curve_json(curve: DataFrame, by: str = S) -> DataFrame:
    """(structure_id, json): a structure's AUC by level of noise (level, auc), as one document."""
    rows = curve.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "auc")))).alias("dephasing"))
    return rows.select(by, F.to_json(F.struct(by, "dephasing")).alias("json"))
