"""Running sums and row numbers over groups of any size: no task holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in `sums`, the sum of its column over the rows of the group that come before in `order`.

    Rows are dealt to tasks by ranges of (group, order) and written; each range's sums pass a window over ranges, a row
    for each task, and the rows pass windows within their range. `order` should tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group]
    dealt = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_all_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in sums])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group], F.col("_range") == F.col("_of"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each task, group and range: as many as tasks, or as groups where these are smaller.
    joined = dealt.withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).join(starts, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_from_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])


def row_numbers(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the row's number within its group, from 0."""
    return running_sums(df, group, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))
