"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

    language ID -> near duplicates -> benchmark decontamination -> personal data -> source mix

The first four return the columns of `documents`: rejected, duplicate and contaminated documents go, personal data is
replaced in the text. The last returns every remaining document with the words that the mix takes of it.

Null texts and texts without a letter go at the first stage; texts of any length are handled whole. Rows are never told
apart by doc_id alone, so null and repeated doc_ids neither lose nor multiply rows; of rows that repeat both doc_id and
text one stays, and of texts that are alike the one with the least doc_id. Extra columns are carried along (columns
that the last stage adds replace such of the same name). An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwave.llm import decontam, langid, mixing, pii, simjoin
from fernwave.llm.common import durable, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simjoin.one_a_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are numbered and written once: doc_id may be null or repeated. Their columns stand apart, so no name clashes.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = durable(docs.select(row, F.monotonically_increasing_id().alias("no")))
    added = ["size", "source_size", "target", "taken"]
    taken = mixing.mix(rows.select("row.doc_id", "row.text", "row.source", "no"), key="no").select(F.col("no").alias("of"), *added)
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return rows.select("row", "no").join(taken, F.col("no") == F.col("of")).select(*kept, *added)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: The first stage is a trained network and the last one draws blocks at random.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
