"""Exact histogram of encoded lengths, and the suffix sums that answer questions about every context limit.

Nulls and empty texts have length 0 and are counted. Repeated rows count as often as they occur. An empty table
gives an empty histogram. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths are dealt to windows in ranges of this width.
RANGE = 1024
#: GPT-2's published split pattern, which the byte-level vocabulary was built with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(vocabulary: bytes):
    """An encoder from the lines of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_length(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each whole text; null gives 0. The vocabulary file is read on the driver and broadcast (about 1 MB)."""
    with open(vocabulary, "rb") as f:
        lines = SparkSession.active().sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_encoding(lines.value).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): the number of documents of every encoded length. Tasks add up before they shuffle.

    The histogram is small and used more than once, so it is written once; no text is encoded twice.
    """
    return durable(docs.select(token_length(F.col(text_col), vocabulary).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens at or above it, and below it.

    `truncated_total` is the number of tokens left when every document is cut at L; `cut_docs` are those longer
    than L; `quantile` is the share of documents of at most L tokens. The lengths pass windows of RANGE lengths,
    and one row for each such range passes a window over all ranges.
    """
    h = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_range", F.floor(F.col("length") / RANGE))
    ranges = h.groupBy("_range").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit("all"))
    later = ranges.select(
        "_range",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(every).alias("all_docs"),
        F.sum("_t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("_range").orderBy(F.desc("length"))
    x = h.join(later, "_range").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.sum("n_docs").over(inside) + F.col("_docs_after")).alias("docs_from"),
        (F.sum("n_tokens").over(inside) + F.col("_tokens_after")).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )
    return x.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        (F.col("docs_from") - F.col("n_docs")).alias("cut_docs"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """The answers for any context limits (column `context_limit`), also such as no document has.

    A limit's answer comes from the smallest length that occurs at or above it; limits beyond all lengths cut
    nothing. Only (limits) x (lengths above) sums are aggregated: a list of limits by a histogram of lengths, whose rows
    are at most as many as the longest document has tokens.
    """
    total = sums.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("_all"))
    first = (
        limits.select("context_limit")
        .distinct()
        .join(sums, sums.length >= F.col("context_limit"), "left")
        .groupBy("context_limit")
        .agg(F.min_by(F.struct("docs_from", "tokens_from"), "length").alias("_x"))
    )
    kept = F.coalesce(F.col("_x.docs_from"), F.lit(0))
    return first.crossJoin(F.broadcast(total)).select(
        "context_limit",
        kept.alias("docs_from"),
        (F.col("_all") - F.coalesce(F.col("_x.tokens_from"), F.lit(0)) + F.col("context_limit") * kept).alias("truncated_total"),
    )
