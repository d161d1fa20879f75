"""Mix sources to target weights: blocks of tokens, multinomial shards, pseudorandom index permutations.

Every source's documents, in the order (hash of doc_id, doc_id, hash of text), are one stream of words, packed into blocks of
`block` words (the last block of a source may be shorter). The mix is a row of output slots, dealt to shards. Each
shard draws how many of its slots go to each source from a multinomial; a source's k-th slot takes the block at the
k-th place of that source's pseudorandom permutation, a new permutation for each pass through the source. Slots that
a source draws beyond its target go, in order, to the sources that drew too few, so every source ends within one
block of its target, and no document is used more often than `most` times. Slots lie in their shard in a pseudorandom
order. `mix` tells how much is taken of each document, `mixed_blocks` which words of which documents every slot holds,
and `mixed_text` what it reads; all three come from the same join of slots with blocks.

Null texts and texts without words have size 0 and are never taken. A null source is a source of its own, the last
one. Repeated rows are separate documents with an equal share. An empty table gives an empty mix. Other columns are
not read. Only the table of sources (at most MOST_SOURCES rows, checked) goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, pieces, running_sum

BLOCK = 128
SHARD = 8192
MOST = 3
SEED = 20_250_101
MOST_SOURCES = 1_000_000
ROUNDS = np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F, 0x78DDE6E5FD29F054], np.uint64)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Words wanted of each source: shares of the total by weight, none above `most` times its own size."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        per = left / fsum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * per > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * per
            break
        for i in full:
            out[i] = float(most * sizes[i])
        open_ -= full
        left = total - fsum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Element by element, the place of i in a pseudorandom permutation of range(n): a Feistel network, cycle-walked."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (_mix64(right + key[todo] + ROUNDS[r : r + 1]) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """The sources in order, their sizes and targets, and how many blocks (slots) of each the mix takes."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: np.ndarray
    slots: np.ndarray

    @property
    def n_slots(self) -> int:
        return int(self.slots.sum())


def make_plan(sources: list[tuple[str | None, int]], block: int = BLOCK, most: int = MOST) -> Plan:
    rows = sorted(sources, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(n) for _, n in rows]
    want = targets(sizes, [float(i % 3 + 1) for i in range(len(rows))], most) if rows else []
    blocks = np.array([-(-n // block) for n in sizes], dtype=np.int64)
    slots = np.zeros(len(rows), dtype=np.int64)
    for i, (n, t) in enumerate(zip(sizes, want, strict=True)):
        if n:
            passes = min(int(t // n), most)
            rest = 0 if passes == most else min(int(blocks[i]), round((t - passes * n) / min(block, n)))
            slots[i] = passes * blocks[i] + rest
    return Plan([r[0] for r in rows], sizes, want, blocks, slots)


def draw_shards(spark, plan: Plan, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, source_no, drawn, first, shard_slots): a multinomial over the sources for each shard, from a generator
    seeded by its number; `first` counts the shard's slots of the sources before."""
    n_slots, p = plan.n_slots, plan.slots / max(1, plan.n_slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                size = min(shard, n_slots - s * shard)
                counts = np.random.Generator(np.random.Philox(key=[seed, s])).multinomial(size, p)
                some = np.flatnonzero(counts)
                first = np.cumsum(counts) - counts
                yield pa.record_batch({"shard": np.full(len(some), s, np.int64), "source_no": some.astype(np.int64), "drawn": counts[some].astype(np.int64), "first": first[some].astype(np.int64), "shard_slots": np.full(len(some), size, np.int64)})

    n = pieces(n_slots, shard, least=0)
    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism * 4))).mapInArrow(draw, "shard long, source_no long, drawn long, first long, shard_slots long")


def fill_slots(spark, plan: Plan, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, block_no), a row for each slot of the mix."""
    n_shards = pieces(plan.n_slots, shard, least=0)
    drawn = durable(draw_shards(spark, plan, shard, seed))
    numbered = running_sum(drawn, ["source_no"], "drawn", "before", "shard", n_shards)
    got = np.zeros(len(plan.slots), np.int64)
    for r in drawn.groupBy("source_no").agg(F.sum("drawn").alias("n")).collect():  # a row for each source
        got[r.source_no] = r.n
    over, under = np.maximum(0, got - plan.slots), np.maximum(0, plan.slots - got)
    over_from, under_upto = np.cumsum(over) - over, np.cumsum(under)
    wanted, blocks = plan.slots, plan.blocks

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, source, count, before, first, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "source_no", "drawn", "before", "first", "shard_slots"))
            if not len(shards):
                continue
            source, shards, size, turn = np.repeat(source, count), np.repeat(shards, count), np.repeat(size, count), np.repeat(np.cumsum(count) - count, count)
            turn = np.arange(len(turn)) - turn
            place, slot = np.repeat(before, count) + turn, np.repeat(first, count) + turn
            slot = permuted(slot, size, _mix64(shards.astype(np.uint64) + np.uint64(seed)))
            late = np.flatnonzero(place >= wanted[source])
            if len(late):
                turn = over_from[source[late]] + place[late] - wanted[source[late]]
                to = np.searchsorted(under_upto, turn, "right")
                source[late], place[late] = to, got[to] + turn - (under_upto[to] - under[to])
            n = blocks[source]
            key = _mix64((source.astype(np.uint64) << np.uint64(8)) + (place // n).astype(np.uint64) + np.uint64(seed))
            yield pa.record_batch({"shard": shards, "slot": slot, "source_no": source, "block_no": permuted(place % n, n, key)})

    return numbered.select("shard", "source_no", "drawn", "before", "first", "shard_slots").mapInArrow(fill, "shard long, slot long, source_no long, block_no long")


def sized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """`_no` tells the rows apart: the column `key`, or else a number, which holds once it is written."""
    number = F.col(key) if key else F.monotonically_increasing_id()
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_mark"), number.alias("_no"))


def laid_out(docs: DataFrame, block: int, shard: int, most: int, seed: int, key: str | None) -> tuple[DataFrame, DataFrame | None]:
    """The documents (_no, doc_id, source, size, source_no, source_size, target, start) in their sources' streams, and
    the mix's slots; None where there is nothing to take."""
    spark = docs.sparkSession
    # Narrow columns, used several times: written once, so that no text is counted twice.
    sizes = durable(sized(docs, key))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    rows = by_source.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    n_docs = sum(r.n for r in rows)
    plan = make_plan([(r.source, r["size"]) for r in rows], block, most)
    table = [(i, s, n, t) for i, (s, n, t) in enumerate(zip(plan.names, plan.sizes, plan.targets, strict=True))]
    known = spark.createDataFrame(table, "source_no long, source string, source_size long, target double")
    known = F.broadcast(known) if len(rows) <= 10_000 else known
    placed = running_sum(
        sizes.join(known, sizes.source.eqNullSafe(known.source)).select("doc_id", "_mark", "_no", sizes.source, "size", "source_no", "source_size", "target"),
        ["source_no"], "size", "start", "doc_id", n_docs, ("_mark", "_no"),
    )
    return placed, fill_slots(spark, plan, shard, seed) if plan.n_slots else None


def in_slots(placed: DataFrame, slots: DataFrame, block: int, how: str) -> DataFrame:
    """Adds (shard, slot, place, first_word, n_words): a row for each piece of a document in a slot, at its place in the
    slot's words. With a left join, pieces that no slot holds have a null slot."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = F.explode_outer if how == "left" else F.explode
    parts = placed.withColumn("block_no", spread(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin, end = F.greatest("start", F.col("block_no") * block), F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)
    return parts.join(slots, ["source_no", "block_no"], how).select(
        *placed.columns, "shard", "slot", (begin - F.col("block_no") * block).alias("place"), (begin - F.col("start")).alias("first_word"), (end - begin).alias("n_words")
    )


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED, key: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row, and `key`, a column of unique whole numbers, if one is named."""
    placed, slots = laid_out(docs, block, shard, most, seed, key)
    named = [F.col("_no").alias(key)] if key else []
    if slots is None:
        return placed.select(*named, "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words"))), F.lit(0)).cast("long")
    by = ["_no", "doc_id", "source", "size", "source_size", "target"]
    return in_slots(placed, slots, block, "left").groupBy(*by).agg(taken.alias("taken")).select(*named, "doc_id", "source", "size", "source_size", "target", "taken")


BLOCKS = "shard long, slot long, place long, doc_id long, source string, first_word long, n_words long"


def _pieces(docs: DataFrame, block: int, shard: int, most: int, seed: int, key: str | None) -> DataFrame | None:
    placed, slots = laid_out(docs, block, shard, most, seed, key)
    return None if slots is None else in_slots(placed, slots, block, "inner")


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(shard, slot, place, doc_id, source, first_word, n_words): what every slot of the mix holds; words count from 0."""
    pieces_ = _pieces(docs, block, shard, most, seed, None)
    return docs.sparkSession.createDataFrame([], BLOCKS) if pieces_ is None else pieces_.select("shard", "slot", "place", "doc_id", "source", "first_word", "n_words")


def mixed_text(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, text): the mix as it is read, a block of at most `block` words a row."""
    rows = durable(docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("_row")))
    pieces_ = _pieces(rows, block, shard, most, seed, "_row")
    if pieces_ is None:
        return docs.sparkSession.createDataFrame([], "shard long, slot long, source string, text string")
    held = pieces_.select("shard", "slot", "place", "_no", pieces_.source.alias("of"), "first_word", "n_words")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("first_word").cast("int") + 1, F.col("n_words").cast("int"))
    cut = held.join(rows, held["_no"] == rows["_row"]).select("shard", "slot", "of", F.struct("place", F.array_join(words, " ").alias("t")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), " ")
    return cut.groupBy("shard", "slot").agg(F.first("of").alias("source"), text.alias("text")).select("shard", "slot", "source", "text")
