"""Fill-in-the-middle: texts are cut at two drawn places and written with the middle last.

Units are words with the whitespace before them; whitespace at the end of a text is a unit of its own. They are found
without a parser: texts are laid out in whole uint64 words of UTF-8, arithmetic on all eight bytes of a word at once
marks the bytes in which units end, `bitwise_count` gives each word's marks, and the k-th unit's end is a binary search
in their running sum and a select within the one word that it finds. Bytes of other characters than ASCII are never
whitespace, so the marks always lie between code points.

Null texts are empty. Empty texts, texts that hold a control string, and those that the draw leaves out stay plain. A
null doc_id is drawn as if its decimal form were empty; rows that repeat a doc_id are drawn alike. Texts of any length
are handled whole. An empty table gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rearranged, and of 100 such so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80

ONES = np.uint64(0x0101010101010101)
HIGH = ONES * np.uint64(0x80)
LOW = ONES * np.uint64(0x7F)
BLANK = np.uint64(0x20)


def whitespace(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a space or lies between 0x09 and 0x0D. No sum leaves its byte."""
    low = words & LOW
    from_tab = low + ONES * np.uint64(0x80 - 0x09)
    past_return = low + ONES * np.uint64(0x80 - 0x0E)
    other = words ^ (ONES * BLANK)
    space = ~(((other & LOW) + LOW) | other)
    return ((from_tab & ~past_return & ~words) | space) & HIGH


def lay_out(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as little-endian words, each row from a new word on and filled up with blanks; and each row's first word."""
    first = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // 8))])
    out = np.full(first[-1] * 8, BLANK, np.uint8)
    for k, to in enumerate(first[:-1] * 8):
        out[to : to + bounds[k + 1] - bounds[k]] = data[bounds[k] : bounds[k + 1]]
    return out.view("<u8").astype(np.uint64), first


def unit_ends(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The high bit of every byte in which a unit ends."""
    blank = whitespace(words)
    after = np.zeros_like(blank)
    after[:-1] = blank[1:] & np.uint64(0x80)
    some = np.flatnonzero(size)
    after[first[1:][some] - 1] = 0x80  # what follows a row counts as whitespace
    ends = ~blank & ((blank >> np.uint64(8)) | (after << np.uint64(56))) & HIGH
    last = first[:-1][some] + (size[some] - 1) // 8
    bit = np.uint64(0x80) << (((size[some] - 1) % 8) * 8).astype(np.uint64)
    ends[last] |= blank[last] & bit
    return ends


def select(ends: np.ndarray, counts: np.ndarray, upto: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The byte of the rank-th mark (from 1) of all; `upto` is the running sum of the words' counts."""
    word = np.searchsorted(upto, rank)
    inside = (rank - (upto[word] - counts[word])).astype(np.uint64)
    marks = (ends[word] >> np.uint64(7)) * ONES  # in each byte, the marks up to it
    reached = ((marks | HIGH) - inside * ONES) & HIGH
    return word * 8 + 8 - np.bitwise_count(reached)


def cut_batch(texts: pa.Array, draws: list[np.ndarray]) -> pd.DataFrame:
    """Each text's units, and the bytes after as many units as each draw leaves modulo one more than there are."""
    data, bounds = utf8(texts)
    n, cuts = np.zeros(len(texts), np.int64), [np.zeros(len(texts), np.int64) for _ in draws]
    for a, b in slices(bounds, 1 << 20):
        size = np.diff(bounds[a : b + 1])
        words, first = lay_out(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        if not len(words):
            continue
        ends = unit_ends(words, first, size)
        counts = np.bitwise_count(ends).astype(np.int64)
        upto = np.cumsum(counts)
        before = np.concatenate([[0], upto])[first]
        n[a:b] = np.diff(before)
        for cut, draw in zip(cuts, draws, strict=True):
            k = draw[a:b] % (n[a:b] + 1)
            some = np.flatnonzero(k)
            cut[a + some] = select(ends, counts, upto, before[:-1][some] + k[some]) + 1 - first[:-1][some] * 8
    return pd.DataFrame({"n": n, "a": np.minimum.reduce(cuts), "b": np.maximum.reduce(cuts)})


def cuts(text: Column, h1: Column, h2: Column) -> Column:
    """struct(n, a, b): units, and the bytes before the middle and before the suffix."""

    @F.pandas_udf("n long, a int, b int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, x, y in batches:
            yield cut_batch(pa.Array.from_pandas(texts, type=pa.string()), [x.to_numpy(np.int64), y.to_numpy(np.int64)])

    return run(text, h1, h2)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from a hash of the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) for every document; the three parts are null where it is plain."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select("doc_id", text.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    x = x.withColumn("at", cuts(F.col("text"), F.col("h1"), F.col("h2")))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    x = x.select("doc_id", "text", "at.n", "at.a", "at.b", form.alias("form"))
    raw, moved = F.col("text").cast("binary"), F.col("form") != "plain"
    piece = lambda since, upto: F.when(moved, F.substring(raw, since + 1, upto - since).cast("string"))
    x = x.select("doc_id", "n", "form", "text", piece(F.lit(0), F.col("a")).alias("prefix"), piece(F.col("a"), F.col("b")).alias("middle"), piece(F.col("b"), F.octet_length(raw)).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return x.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form. Parts hold no control string, nor can one arise where a part meets one."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) from what `transform` returns."""
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
