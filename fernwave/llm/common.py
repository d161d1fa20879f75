"""Helpers shared by the text operators: reading, durable cuts of lineage, prefix sums, text arrays."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); in local mode one is made where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a replicated checkpoint, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def pieces(total: float, each: float, least: int = 1) -> int:
    """How many pieces of about `each` a total is dealt into."""
    return max(least, math.ceil(total / each))


def running_sum(df: DataFrame, group: list[str], value: str, out: str, id_col: str, n_rows: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Exclusive running sum of `value` within `group`, in the order (hash bucket of the id, id, ties).
    Rows with a null id are dealt to buckets by `ties`.

    Two levels: rows are summed by (group, bucket), only those sums pass a window by group, and the rows
    themselves pass windows by (group, bucket). No task holds a whole group however large that is.
    """
    n = pieces(math.sqrt(max(1, n_rows)), 1)  # as many buckets as rows in a bucket
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col), *[F.when(F.col(id_col).isNull(), F.col(c)) for c in ties]), F.lit(n)))
    keys = [F.col(c) for c in group]
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*group, "_bucket", F.coalesce(before, F.lit(0)).cast("long").alias("_start"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(id_col, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_bucket"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = ranked.alias("a").join(starts.alias("b"), cond)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b._start") + F.col("a._in")).alias(out))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, joined, and each row's bounds in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows [a, b) of at most `most` bytes, or of one row."""
    out, a, n = [], 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out
