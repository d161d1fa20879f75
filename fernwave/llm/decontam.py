"""Benchmark decontamination: a hash set of test n-grams, scanned for in every document. DataFrame functions only.

Words are maximal runs of digits, a-z and characters above 0x7F after A-Z are lower-cased. A window is 13 consecutive
words of an item; an item of fewer words, but not none, is one window. Every window is found by its first (up to four)
words: their 64-bit hash is looked up at each word of a document in a hash set of those of the benchmark, which is sent
to all tasks. Only the places that it holds leave a document's row; they are joined with the windows by that hash, and
compared word for word.

The set is one table of marked slots, two for each hash, of SLOTS bytes at most. It may hold places that are no match
(the join settles that) but misses none, so there is one way for every size of benchmark: with more hashes than slots
more places go into the join, and the join's side of windows is sent to tasks or shuffled as Spark finds by its size.

Null and empty texts have no words and are clean; a null or wordless item has no windows. Repeated items are told apart
by item_id, rows with the same item_id are one item. Every row of documents gives one row, also one that repeats a doc_id (a
null one too), with the same text or another; equal rows are judged once. An empty table gives none. Other columns, whatever their names, are
kept by `decontaminate` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 13
KEY = 4
#: Slots of the hash set: at least so many for each hash, and no more than this in all.
SPACE, SLOTS = 16, 1 << 24
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE = "array<struct<at:int,k:int,key:bigint,ws:array<string>>>"


def words(text: Column) -> Column:
    """The words as they stand in the text; `lowered` gives their normal form. Null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_hashes(ws: Column) -> Column:
    """A hash of each word. lower() is a function of the A-Z-lowered word, so equal words up to A-Z case have equal hashes."""
    return F.transform(ws, lambda x: F.xxhash64(F.lower(x)))


def key_hash(hashes: Column, i: Column, k: int) -> Column:
    """Hash of the k words from the 1-based place i on."""
    return F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(k)])


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(window, length, k, key, item_ids): each distinct window of the benchmark once."""
    item = benchmark.select("item_id", words(lowered(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    one = item.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("ws"))
    k, hashes = F.least(F.lit(KEY), F.size("ws")), word_hashes(F.col("ws"))
    key = F.when(k == 1, key_hash(hashes, F.lit(1), 1))
    for j in range(2, KEY + 1):
        key = key.when(k == j, key_hash(hashes, F.lit(1), j))
    keyed = one.select("item_id", F.array_join("ws", " ").alias("window"), F.size("ws").alias("length"), k.alias("k"), key.alias("key"))
    return keyed.groupBy("window", "length", "k", "key").agg(F.collect_set("item_id").alias("item_ids"))


def slots_of(key: Column, n_slots: int) -> list[Column]:
    return [F.pmod(key, F.lit(n_slots)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(n_slots))]


def hash_set(windows: DataFrame, most: int = SLOTS) -> tuple[bytes, list[int]]:
    """One byte for each slot, 1 where some window's key falls, and the lengths k of keys; what reaches the driver is `most` bits."""
    keys = windows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["k"]: r["n"] for r in keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most KEY rows
    n_slots = min(most, max(1 << 15, 1 << (SPACE * sum(counts.values()) - 1).bit_length())) if counts else 1 << 15
    slot = keys.select(F.explode(F.array(*slots_of(F.col("key"), n_slots))).alias("slot"))
    maps = slot.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    parts = {r["bucket"]: r["bits"] for r in maps}
    spread = [bytes(x >> b & 1 for b in range(8)) for x in range(256)]
    none = bytes(1 << 12)
    # Slot s is bit (s - 1) mod 2^15 of bucket (s - 1) / 2^15 + 1, as Spark numbers them; slot 0 is bit 0 of bucket 0.
    table = b"".join(b"".join(spread[x] for x in parts.get(k, none)) for k in range(1, (n_slots >> 15) + 1))
    first = bytes([parts[0][0] & 1]) if 0 in parts else b"\0"
    return first + table, sorted(counts)


def scanned(docs: DataFrame, windows: DataFrame, row: list[str]) -> DataFrame:
    """(row columns, n_words, at, window, length, item_ids): a row for each occurrence, and at least one for each document."""
    table, ks = hash_set(windows)
    marked, yes = F.lit(bytearray(table)), F.lit(bytearray(b"\1"))
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most 13
    raw = docs.select(*row, words(F.col("text")).alias("w"))
    hashed = raw.select(*row, "w", word_hashes(F.col("w")).alias("h"))
    n_slots = len(table) - 1

    def places(k: int) -> Column:
        every = F.sequence(F.lit(1), F.size("h") - (k - 1))
        keyed = F.transform(every, lambda i: F.struct(i.alias("at"), key_hash(F.col("h"), i, k).alias("key")))

        def held(p: Column) -> Column:
            one, two = (F.substring(marked, s.cast("int") + 1, F.lit(1)) == yes for s in slots_of(p["key"], n_slots))
            return one & two

        found = F.transform(F.filter(keyed, held), lambda p: F.struct(p["at"].alias("at"), F.lit(k).alias("k"), p["key"].alias("key"), F.slice(F.col("w"), p["at"], N).alias("ws")))
        return F.when(F.size("h") >= k, found).otherwise(F.array().cast(PLACE))

    # Each document also has one place that matches nothing, under a hash of its own: it keeps its row in the join, on any task.
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.xxhash64(*row).alias("key"), F.array().cast("array<string>").alias("ws"))).cast(PLACE)
    found = F.concat(own, *[places(k) for k in ks])
    one = hashed.select(*row, F.size("w").cast("long").alias("n_words"), F.explode(found).alias("f")).select(*row, "n_words", "f.*")
    one = one.withColumn("ws", F.transform("ws", lambda x: lowered(x)))
    right = windows.select("window", "length", F.col("k").alias("_k"), F.col("key").alias("_key"), "item_ids")
    match = (one["k"] == right["_k"]) & (one["key"] == right["_key"])
    for length in lengths or [0]:
        match = match & ((right["length"] != length) | (F.array_join(F.slice(one["ws"], 1, length), " ") == right["window"]))
    return one.join(right, match, "left").select(*row, "n_words", "at", "window", "length", "item_ids")


def covered(spans: Column) -> Column:
    """How many words the (at, length) spans of a sorted array cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["length"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], s["at"]))).cast("long").alias("n"))

    return F.aggregate(spans, start, step)["n"]


#: Copies of a row that are held at once when equal rows are told apart again.
COPIES = 1000


def judged(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, copies): a row for all rows of docs that are equal."""
    windows = benchmark_windows(benchmark, n)
    # Rows with the same doc_id and another text are judged each by its own.
    seen = scanned(docs.select("doc_id", "text", F.sha2("text", 256).alias("_text")), windows, ["doc_id", "_text"])
    hit = F.when(F.col("length").isNotNull(), F.struct("at", "length"))
    grouped = seen.groupBy("doc_id", "_text").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"),
        F.count_if(F.col("at") == 0).alias("copies"),  # the place of its own that each row of docs has once
    )
    n_hit = covered(F.col("spans"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return grouped.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "copies",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of docs."""
    one = judged(docs, benchmark, n)
    kept = [c for c in one.columns if c != "copies"]
    some = one.select(*kept, "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    each = F.array_repeat(F.lit(True), F.least(F.lit(COPIES), F.col("copies") - F.col("first")).cast("int"))
    return some.select(*kept, F.explode(each).alias("_one")).drop("_one")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    # By text, not by doc_id: rows with a null or repeated doc_id are judged each by its own.
    key = F.sha2(F.col("text"), 256)
    bad = judged(docs.select(key.alias("doc_id"), "text"), benchmark, n).filter("contaminated").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, key == F.col("_bad"), "left_anti")
