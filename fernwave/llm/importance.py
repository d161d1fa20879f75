"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their features.

Features are runs of words, hashed into buckets. Their counts in the corpus and in the target are two arrays of fixed
length, which give every bucket a gain in thousandths of a nat; a document's weight is the mean gain of its features,
read from the array. Gumbel noise from a hash of doc_id is added, so that the highest scores are a draw without
replacement in proportion to the weights' exponentials.

Scores are written once, in a narrow table. Where the draw ends is found by exact counts over it: each job counts the
rows up to several thresholds between two bounds and so narrows them, first on the score, then on the doc_ids of the
rows that tie at it. Only rows within the cutoff are put in order, by ranges over all tasks.

Null texts have no features, weight 0, and are never drawn, nor are texts of fewer words than LEAST_WORDS. A null doc_id
is hashed as if its decimal form were empty, and comes last among ties; rows that repeat a doc_id tie, and go by
n_features and then in any order, one rank each. Without any target text all gains are those of an empty target. An
empty corpus gives no rows. Texts of any length are handled whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import row_numbers
from .common import durable

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Thresholds that one job counts at.
SECTIONS = 16
#: What a task remembers of words that it has hashed.
REMEMBERED = 1 << 20

# A to Z as a to z; digits, letters and bytes beyond ASCII as they are; all else blank.
_FOLD = bytes((c | 0x20) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Hashed(dict):
    """The bucket of a feature, remembered while there is room."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = k = crc32(feature) % self.buckets
        return k


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def features(words: list[bytes], longest: int, hashed: Hashed) -> np.ndarray:
    """The buckets of all runs of up to `longest` words."""
    parts = [np.fromiter(map(hashed.__getitem__, words), np.int64, len(words))]
    for n in range(2, min(longest, len(words)) + 1):
        parts.append(np.fromiter((hashed[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)), np.int64))
    return np.concatenate(parts)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often features of all texts fall into each bucket. A task sends at most a row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hashed = np.zeros(buckets, np.int64), Hashed(buckets)
        for pdf in batches:
            for t in pdf["text"]:
                total += np.bincount(features(words_of(t), longest, hashed), minlength=buckets) if t else 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    return texts.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket. Two arrays of `buckets` numbers reach the driver, whatever the tables' sizes."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, longest, buckets).collect():
            out[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(text: Column, gain: np.ndarray, longest: int = LONGEST) -> Column:
    """struct(n_words, n_features, weight) of each whole text."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashed = Hashed(len(gain))
        for texts in batches:
            out = np.zeros((len(texts), 3), np.int64)
            for k, t in enumerate(texts):
                if words := words_of(t):
                    f = features(words, longest, hashed)
                    out[k] = len(words), len(f), gain[f].sum() // len(f)
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return run(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u)))


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, no): `no` tells apart rows that are alike."""
    w = weighed(F.col("text"), gains(docs, target, longest, buckets), longest)
    x = docs.select("doc_id", w.alias("w")).select("doc_id", "w.*")
    return x.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("no"))


def least_value(rows: DataFrame, value: Column, wanted: int, low: int, high: int) -> int:
    """The least number v from low to high such that at least `wanted` rows have a value of at most v; `high` must be one."""
    while low < high:
        at = sorted({low + (high - low) * k // SECTIONS for k in range(SECTIONS)})
        n = rows.agg(*[F.count_if(value <= F.lit(v)).alias(f"n{k}") for k, v in enumerate(at)]).first()
        enough = [k for k in range(len(at)) if n[k] >= wanted]
        if enough:
            high = at[enough[0]]
            low = at[enough[0] - 1] + 1 if enough[0] else low
        else:
            low = at[-1] + 1
    return low


def within(rows: DataFrame, wanted: int) -> Column:
    """Whether a row comes up to the cutoff in the order (score, the highest first; doc_id, null last).

    That is true of `wanted` rows, and of more only where rows tie with the last one in both.
    """
    score, doc_id = F.col("score"), F.col("doc_id")
    ends = rows.agg(F.min(-score), F.max(-score)).first()
    cut = -least_value(rows, -score, wanted, ends[0], ends[1])
    tied = rows.filter(score == cut)
    n = rows.agg(F.count_if(score > cut).alias("above"), F.count_if((score == cut) & doc_id.isNotNull()).alias("tied")).first()
    if n["above"] + n["tied"] < wanted:  # rows without a doc_id are needed as well
        return score >= cut
    ends = tied.agg(F.min("doc_id"), F.max("doc_id")).first()
    last = least_value(tied, doc_id, wanted - n["above"], ends[0], ends[1])
    return (score > cut) | ((score == cut) & F.coalesce(doc_id <= last, F.lit(False)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    rows = durable(scored(docs, target, longest, buckets, seed))
    able = F.col("n_words") >= least_words
    wanted = rows.filter(able).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*out, none)
    chosen = able & within(rows.filter(able), wanted)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("no")]
    ranked = row_numbers(rows.filter(chosen), [], order, "place")
    drawn = F.when(F.col("place") < wanted, F.col("place") + 1)
    return ranked.select(*out, drawn.alias("rank")).unionByName(rows.filter(~chosen).select(*out, none))
