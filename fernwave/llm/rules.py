"""Quality rules as a ledger: every rule is evaluated once, and its outcome kept as one bit beside the measurements.

`ledger` reads each whole text once and gives a row of measurements and a bit mask of the rules that the document
fails. Policies are versioned sets of rules; applying one is a test of the mask, so a new policy, or the question what a
policy would keep without one of its rules, never reads a text again. `ablations` counts documents by mask, a table of at
most as many rows as masks occur, and answers from those.

Words are runs without ASCII whitespace; a line is what stands between line feeds, and counts if it holds a word. A null
text has no words, and fails `few_words`. Every row is measured by itself, so repeated rows and null or repeated doc_ids
get rows of their own. Texts of any length are handled whole. An empty table gives an empty ledger and no ablations.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
UNLETTERED = bytes(c for c in range(0x80) if not chr(c).isalpha() and c not in SPACE)
WINDOW = 3

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lettered", "n_shouted"]

#: A rule's place is its bit: new ones go to the end, and none is ever taken away.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "2 * n_shouted > n_words",
    "unlettered": "5 * n_lettered < 4 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
BITS = {rule: 1 << k for k, rule in enumerate(RULES)}

POLICIES = {
    "base-1": ["few_words", "repeated_words"],
    "prose-1": ["few_words", "repeated_words", "symbols", "shouting"],
    "prose-2": list(RULES),
}
CURRENT = "prose-2"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows that occur more than once. Words are numbered, and windows told apart by exact pairs of numbers."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number = defaultdict(count().__next__)
    code = ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    for k in range(1, WINDOW):
        code = code[:-1] * len(number) + ids[k:]
        _, code, times = np.unique(code, return_inverse=True, return_counts=True)
    hit, often = np.zeros(n, bool), times[code] > 1
    for k in range(WINDOW):
        hit[k : n - WINDOW + 1 + k] |= often
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The values of MEASURES of one text in UTF-8."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text.translate(None, UNLETTERED).split()),
        sum(map(bytes.isupper, words)),
    )


def measured(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure((t or "").encode()) for t in texts], columns=MEASURES, dtype="int64")

    return run(F.coalesce(text, F.lit("")))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): `failed` has the bit of each rule that the document fails."""
    x = docs.select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(rule), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return x.withColumn("failed", failed)


def stored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger as a Parquet table in the shared folder, read back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/quality-ledger-{uuid.uuid4().hex}"
    ledger(docs).write.parquet(path)
    return spark.read.parquet(path)


def mask(policy: str, policies: dict[str, list[str]] = POLICIES) -> int:
    return sum(BITS[r] for r in policies[policy])


def fails(policy: str, policies: dict[str, list[str]] = POLICIES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy, policies)).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: str = CURRENT, policies: dict[str, list[str]] = POLICIES) -> DataFrame:
    """Adds `kept` and `policy` to a ledger."""
    return rows.withColumns({"kept": ~fails(policy, policies), "policy": F.lit(policy)})


def ablations(rows: DataFrame, policies: dict[str, list[str]] = POLICIES) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept, n_kept_without, ever_with, always_with), a row for each rule of each policy.

    `n_only` documents fail no other rule of the policy, so that `n_kept_without` are kept when this one is left out.
    `ever_with` and `always_with` are masks of those other rules that some, or all, of its documents fail too: with a bit in
    `always_with` the rule is redundant.
    """
    kinds = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n_docs"))
    pairs = [(p, r, BITS[r], mask(p, policies)) for p in policies for r in policies[p]]
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask")) for p, r, b, m in pairs])
    x = kinds.select("failed", "n_docs", F.explode(each).alias("p")).select("failed", "n_docs", "p.*")
    within = F.col("failed").bitwiseAND(F.col("mask"))
    own = F.col("failed").bitwiseAND(F.col("bit")) != 0
    others = F.when(own, within.bitwiseXOR(F.col("bit")))
    sums = x.groupBy("policy", "rule").agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n_docs"))), F.lit(0)).alias(n) for n, c in (("n_failed", own), ("n_only", within == F.col("bit")), ("n_kept", within == 0))],
        F.coalesce(F.bit_or(others), F.lit(0)).alias("ever_with"),
        F.coalesce(F.bit_and(others), F.lit(0)).alias("always_with"),
    )
    return sums.select("policy", "rule", "n_failed", "n_only", "n_kept", (F.col("n_kept") + F.col("n_only")).alias("n_kept_without"), "ever_with", "always_with")


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(doc_id, measurements, failed, base_failed, kept, policy) of every document, through a stored ledger."""
    return apply_policy(stored(docs), policy).withColumn("base_failed", fails("base-1")).withColumn("kept", ~F.col("base_failed") & F.col("kept"))
