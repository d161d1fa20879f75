"""Structure files as a stream: every file that arrives is parsed, scored and ranked in the micro-batch that brings it.

A structure is complete in its file, so nothing is kept between batches; the file source's log and the batch number in
the output path make a restarted query write each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, ranking, spectral
from ..operators.graph import S
from ..sources.structures import load_nodes, parse_atoms


def structure_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(structure_id, line_no, line) of the files that arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    named = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.\w+)?$", 1).alias(S), "value")
    return named.select(S, F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def top_hits(lines: DataFrame, top: int = 5, cutoff: float = 8.0) -> DataFrame:
    """Banded interference scores of the largest chain's nodes, the best `top` of each structure."""
    nodes = load_nodes(parse_atoms(lines))
    edges = graph.contact_edges(nodes, cutoff)
    scores = spectral.band_scores(nodes, edges, "interference", "logf", 1.0)
    return ranking.hit_list(ranking.finalize(scores), nodes, top).select(S, "pos", "node_id", "chain", "resseq", "icode", "resname", "score")


def rank_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, top: int = 5) -> StreamingQuery:
    """Starts a query that writes the hits of each batch to out/batch=<number>; it ends when all files are read."""

    def write(batch: DataFrame, number: int) -> None:
        top_hits(batch, top).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return structure_lines(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
