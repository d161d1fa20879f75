"""Point tables from the star schema: nodes of one structure, or of one structure for each label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 100.0
#: Ids to a block: structures are a label's points of one block of ids, so their size is bounded however long the table is.
IDS = 10_000


def embedding_nodes(spark: SparkSession, sf_dir: str, by_label: bool = False, whole: bool = False) -> DataFrame:
    """(structure_id, node_id, x, y, z, y01, is_active, label): the first three components are the coordinates. With `whole`,
    a label's structure holds all its points, however many there are."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    block = F.when(F.col("vec_id") >= IDS, F.concat(F.lit("."), F.floor(F.col("vec_id") / IDS).cast("string"))).otherwise("")
    at = lambda k: (F.lit(SCALE) * F.col("embedding")[k].cast("double"))
    return e.select(
        (F.concat(F.col("label").cast("string"), *([] if whole else [block])) if by_label else F.lit("all")).alias("structure_id"),
        F.col("vec_id").alias("node_id"),
        at(0).alias("x"),
        at(1).alias("y"),
        at(2).alias("z"),
        (F.col("label") == 0).cast("int").alias("y01"),
        (F.col("vec_id") % 50 == 0).alias("is_active"),
        "label",
    )
