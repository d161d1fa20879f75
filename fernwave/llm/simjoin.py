"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact set arithmetic decides.

A document is the set of its runs of `size` words (lower-cased A-Z; words are runs of digits, letters and characters
above 0x7F; fewer words, but not none, are one run). Two documents are linked if the sets' Jaccard similarity is
`threshold` or more.

1. Documents with equal sets are one class of copies, named by its least doc_id; only that one goes on.
2. Each tree of the forest is a sorted trie of signatures of DEPTH MinHash values. Neighbours in sorted order are
   candidates at the level of their longest common prefix: the rows that share a prefix of some length lie side by side,
   so links between neighbours of that level or a deeper one hold them together. The tries are sorted by range over all
   tasks, so a prefix that very many documents share is spread like any other.
3. Prefixes are shortened step by step, from DEPTH on. Candidates that hang together form families, in which all pairs
   that were not compared at an earlier step are compared exactly. After each step the least similarity of the pairs
   verified so far tells how likely a pair like that is found at prefixes of this length; when this reaches the target
   recall, shortening stops, else the prefix is cut to the length that reaches it. It stops at the latest where a pair of
   exactly the threshold is found with that chance.
4. Families are compared in blocks of bounded size that are dealt to tasks; counts and spanning links leave a task,
   never pairs. Families of more than BLOCK documents are parted first: by set size, as sets of which one is less than
   `threshold` of the other cannot be linked, and the largest family of the level before from what has joined it, so that
   what was compared within it is not sent again.
5. Classes are the connected components of verified links.

Null texts and texts without words have an empty set: each is a class of its own, without links. Repeated rows (an
equal doc_id) give equal rows; doc_id names a document, so rows that repeat one with another text count as the same. A
null doc_id gets a null class. Ties (equal sets) go to the least doc_id. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces
from .components import EACH, LEAST, components
from .shingles import SIZE, shingle_sets

THRESHOLD = (4, 5)
TREES, DEPTH, RECALL = 32, 8, 0.9999
BLOCK, ROWS = 128, 1000
SEED = 11


def chance(similarity: float, prefix: int, trees: int = TREES) -> float:
    """How likely two sets of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def longest_prefix(similarity: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of this similarity is found often enough."""
    d = depth
    while d > 1 and chance(similarity, d, trees) < recall:
        d -= 1
    return d


def _functions() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(SEED)
    n = TREES * DEPTH
    return g.integers(1 << 62, (1 << 63) - 1, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, (1 << 63) - 1, n).astype(np.uint64)


def signatures(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(rows, TREES, DEPTH) 16-bit MinHash values; rows of empty sets are zero."""
    a, b = _functions()
    out = np.zeros((len(count), TREES * DEPTH), np.uint16)
    full = np.flatnonzero(count)
    ends = np.cumsum(count[full])
    i = 0
    while i < len(full):  # sets of about 64k values stay in a core's cache through all functions
        base = int(ends[i] - count[full[i]])
        j = max(i + 1, int(np.searchsorted(ends, base + 65_536, "right")))
        part = sets[base : int(ends[j - 1])]
        starts = np.concatenate([[0], ends[i : j - 1] - base])
        for k in range(TREES * DEPTH):
            least = np.minimum.reduceat(part * a[k] + b[k], starts)
            out[full[i:j], k] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        i = j
    return out.reshape(len(count), TREES, DEPTH)


def sketch(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, set_key, n_shingles, signature): set_key is a strong digest of the whole set; null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, count in shingle_sets(batch.column(1), size):
                ends, raw, sig = np.cumsum(count), sets.tobytes(), signatures(sets, count).astype(">u2")
                keys, marks = [], []
                for k, (e, n) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)):
                    keys.append(hashlib.blake2b(raw[8 * (e - n) : 8 * e], digest_size=16).digest() if n else None)
                    marks.append(sig[k].tobytes() if n else None)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(keys, pa.binary()), pa.array(count, pa.int64()), pa.array(marks, pa.binary())], names=["doc_id", "set_key", "n_shingles", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, set_key binary, n_shingles long, signature binary")


def forest(signed: DataFrame) -> DataFrame:
    """(tree, trie, doc_id) of (doc_id, signature): every document's values in each tree, in the order of the trie's levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sig = pa.py_buffer(b"".join(b.column(1).to_pylist()))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), n * TREES, [None, sig])
            ids = b.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))
            yield pa.record_batch([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), flat.cast(pa.binary()), ids], names=["tree", "trie", "doc_id"])

    return signed.select("doc_id", "signature").mapInArrow(run, "tree int, trie binary, doc_id long")


def neighbours(tries: DataFrame, shortest: int) -> DataFrame:
    """(u, v, level): neighbours in the sorted tries and the longest prefix that they share in any, from `shortest` on."""
    # tries are sorted by all their values, and equal ones by doc_id: tasks get ranges of even size
    n = int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tries.repartitionByRange(n, "tree", "trie", "doc_id").sortWithinPartitions("tree", "trie", "doc_id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last = TaskContext.get().partitionId(), None, None
        names = ["u", "v", "level", "part", "side", "head"]

        def rows(u, v, level, part, side, head):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip((u, v, level, part, side, head), kinds, strict=True)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            trees, ids = b.column(0).to_numpy(), b.column(2).to_numpy()
            heads = [t.to_bytes(2, "big") + k for t, k in zip(trees.tolist(), b.column(1).to_pylist(), strict=True)]
            if last is not None:
                heads, ids = [last[0], *heads], np.concatenate([[last[1]], ids])
            if first is None:
                first = (heads[0], ids[0])
            values = np.frombuffer(b"".join(heads), ">u2").reshape(len(heads), DEPTH + 1)
            level = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1) - 1  # the tree's number is no level
            near = np.flatnonzero((level >= shortest) & (ids[1:] != ids[:-1]))
            last = (heads[-1], ids[-1])
            none = [None] * len(near)
            yield rows(ids[near], ids[near + 1], level[near], none, none, none)
        if first is not None:
            yield rows([first[1], last[1]], [None, None], [None, None], [task, task], [0, 1], [first[0], last[0]])

    seen = dealt.mapInArrow(link, "u long, v long, level int, part int, side int, head binary")
    out = durable(seen.groupBy("u", "v", "part", "side", "head").agg(F.max("level").alias("level")))
    out = out.coalesce(pieces(out.count(), EACH, LEAST))
    # The ends of ranges: two rows of each task.
    order = Window.orderBy("part", "side")
    ends = out.filter("part IS NOT NULL").select("u", "head", "side", F.lag("u").over(order).alias("v"), F.lag("head").over(order).alias("before"))
    common = F.lit(0)
    for k in range(DEPTH, shortest - 1, -1):  # the least of them is tested last and so stands innermost
        same = F.substring("head", 1, 2 * (k + 1)) == F.substring("before", 1, 2 * (k + 1))
        common = F.greatest(common, F.when(same, k).otherwise(0))
    across = ends.filter("side = 0 AND v IS NOT NULL AND u <> v").select("u", "v", common.alias("level")).filter(F.col("level") >= shortest)
    return out.filter("part IS NULL").select("u", "v", "level").unionByName(across)


def exact(first: list[np.ndarray], second: list[np.ndarray] | None, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs reach the threshold, and all similarities: rows of `first` by rows of `second` (or of itself, without the diagonal)."""
    every = first + (second or [])
    size = np.array([len(s) for s in every], np.int64)
    codes, inverse, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(every)), size)
    keep = times[inverse] > 1  # what one row has alone is in no intersection
    row, col = row[keep], shared[inverse[keep]]
    n, m, width = len(first), len(every), 8192
    both = np.zeros((n, m - n) if second is not None else (n, n), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        a, z = np.searchsorted(col, [at, at + width])
        part = np.zeros((m, width), np.float32)
        part[row[a:z], col[a:z] - at] = 1
        both += part[:n] @ (part[n:] if second is not None else part).T
    either = size[:n, None] + (size[n:] if second is not None else size)[None, :] - both
    out = both * threshold[1] >= either * threshold[0]
    if second is None:
        np.fill_diagonal(out, False)
    return out, both / np.maximum(either, 1)


def _spanning(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric matrix of links is connected with."""
    root = ids.copy()
    while True:
        least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(root, least)
        if (new == root).all():
            return root
        root = new


def block_size(total):
    """Documents of a family in a block: BLOCK at least, and so many that none is sent to more than some 35, but in vast families."""
    return min(4096, max(BLOCK, total // 32))


def shingled(docs: DataFrame, nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, shingles) of the documents among nodes (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, count in shingle_sets(batch.column(1), size):
                ends = np.cumsum(count)
                data = [sets[e - n : e].tobytes() for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "n_shingles", "shingles"])

    some = docs.filter("text IS NOT NULL").join(nodes, docs["doc_id"] == nodes["node"], "left_semi")
    return some.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, shingles binary")


def verify(sets: DataFrame, members: DataFrame, first: bool, tasks: int, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, root, links, least) for members (node, old, family): a row for each document and block in which it has links.

    Pairs within the same `old` family were compared before and are passed over; at the `first` level none were. `least` is the least similarity of
    the block's linked pairs. Rows are dealt by their number as sent, copies for several blocks included.
    """
    # Sets whose bands are more than one apart cannot be linked; bands are a little wider than that asks for.
    width = math.log(threshold[1] / threshold[0]) * (1 + 1e-9)
    light = sets.select("doc_id", F.floor(F.log("n_shingles") / width).cast("int").alias("band"))
    banded = members.join(light, members["node"] == light["doc_id"]).groupBy("node").agg(F.min("old").alias("old"), F.min("family").alias("family"), F.min("band").alias("band"))
    if first:
        parted = durable(banded.withColumn("part", 2 * F.col("band")).coalesce(tasks))
    else:
        # What is joined with a family's rows is written before, so that a join's skewed parts can be split.
        olds = banded.groupBy("family", "old").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
        main = durable(olds.groupBy("family").agg(F.max_by("old", F.struct("n", "old")).alias("main")).coalesce(tasks))
        parted = durable(banded.join(main, "family", "left").withColumn("part", 2 * F.col("band") + F.coalesce((F.col("old") == F.col("main")).cast("int"), F.lit(0))).drop("main").coalesce(tasks))
    counts = parted.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    # At most some 160 parts.
    of = durable(counts.groupBy("family").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("parts")).coalesce(tasks))
    block = F.least(F.lit(4096), F.greatest(F.lit(BLOCK), F.floor(F.col("total") / 32)))
    most = F.when(F.col("total") > BLOCK, F.col("total") * (F.ceil(F.col("total") / block) + 3)).otherwise(F.col("total"))  # rows sent, or a few more
    n_sent = of.agg(F.sum(most)).first()[0] or 0
    n_deal = pieces(n_sent, ROWS)
    named = parted.join(of, "family").select(F.col("node").alias("_node"), "old", "family", "part", "total", F.map_entries("parts").alias("parts"))
    rows = sets.join(named, sets["doc_id"] == named["_node"]).select("doc_id", "shingles", "old", "family", "part", "total", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["deal", "family", "low", "high", "own", "old", "doc_id", "shingles"]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        for batch in batches:
            out = []
            for doc, data, old, fam, part, total, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_of = {e["key"]: e["value"] for e in parts}
                size = block_size(total)
                mark = int.from_bytes(hashlib.blake2b(doc.to_bytes(8, "big", signed=True), digest_size=4).digest(), "big")
                if total <= BLOCK:
                    part, n_of = 0, {0: total}
                own = (part << 32) + mark % -(-n_of[part] // size)
                # Parts of the same and the next bands; the main one's documents have all met each other.
                meets = [2 * (part // 2 + step) + side for step in (-1, 0, 1) for side in (0, 1) if not part % 2 or not side] if total > BLOCK else [part]
                for p in meets:
                    for k in range(-(-n_of.get(p, 0) // size)):
                        low, high = sorted((own, (p << 32) + k))
                        deal = int.from_bytes(hashlib.blake2b(b"%d %d %d" % (fam, low, high), digest_size=4).digest(), "big") % n_deal
                        out.append((deal, fam, low, high, own, old, doc, data))
                if len(out) >= 2000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def check(key: tuple, t: pa.Table) -> pa.Table:
        fam, low, high, own, old, ids = (t.column(c).to_numpy() for c in ("family", "low", "high", "own", "old", "doc_id"))
        data = t.column("shingles").to_pylist()
        order = np.lexsort((ids, own, high, low, fam))
        begin = np.flatnonzero(np.append(True, (np.diff(fam[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)))
        got: list[tuple[np.ndarray, ...]] = []
        for a, z in zip(begin, [*begin[1:], len(order)], strict=True):
            rows = order[a:z]
            rows = rows[np.append(True, np.diff(ids[rows]) != 0)] if low[rows[0]] == high[rows[0]] else rows[np.sort(np.unique(ids[rows], return_index=True)[1])]
            # One old family has nothing new within it.
            if (old[rows] == old[rows[0]]).all():
                continue
            sets, doc, mine = [np.frombuffer(data[r], np.uint64) for r in rows], ids[rows], own[rows] == low[rows]
            n = int(mine.sum())
            if low[rows[0]] == high[rows[0]]:
                linked, alike = exact(sets, None, threshold)
                before = old[rows]
            elif 0 < n < len(rows):
                doc, before = (np.concatenate([x[mine], x[~mine]]) for x in (doc, old[rows]))
                cross, part = exact([s for s, m in zip(sets, mine, strict=True) if m], [s for s, m in zip(sets, mine, strict=True) if not m], threshold)
                linked, alike = np.zeros((len(rows), len(rows)), bool), np.ones((len(rows), len(rows)))
                linked[:n, n:], linked[n:, :n], alike[:n, n:] = cross, cross.T, part
            else:
                continue
            linked &= before[:, None] != before[None, :]
            links = linked.sum(axis=1)
            some = links > 0
            if some.any():
                least = np.full(int(some.sum()), alike[linked].min())
                got.append((doc[some], _spanning(linked, doc)[some], links[some], least))
        kinds = (np.int64, np.int64, np.int64, np.float64)
        parts = [np.concatenate([g[k] for g in got]).astype(t) if got else np.zeros(0, t) for k, t in enumerate(kinds)]
        return pa.table(dict(zip(("doc_id", "root", "links", "least"), parts, strict=True)))

    cut_rows = rows.mapInArrow(cut, "deal long, family long, low long, high long, own long, old long, doc_id long, shingles binary")
    return cut_rows.groupBy("deal").applyInArrow(check, "doc_id long, root long, links long, least double")


def joined_families(families: DataFrame | None, links: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(changed, all): families (node, family) after links (u, v) have joined some; changed ones with the `old` family of each node."""
    if families is None:
        changed = components(links).select("node", F.col("node").alias("old"), F.col("root").alias("family"))
        return changed, changed.select("node", "family")
    of = lambda end: families.select(F.col("node").alias(f"_{end}"), F.col("family").alias(f"f{end}"))
    ends = links.join(of("u"), F.col("u") == F.col("_u"), "left").join(of("v"), F.col("v") == F.col("_v"), "left")
    lifted = ends.select(F.coalesce("fu", "u").alias("u"), F.coalesce("fv", "v").alias("v")).filter("u <> v")
    moves = components(lifted).select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    # A family's name is its least node, so a name that is no node of a family stands for a document without one.
    alone = moves.join(families, F.col("_from") == F.col("node"), "left_anti").select(F.col("_from").alias("node"), F.col("_from").alias("family"))
    every = families.unionByName(alone).join(moves, F.col("family") == F.col("_from"), "left")
    placed = durable(every.select("node", F.col("family").alias("old"), F.coalesce("_to", "family").alias("family"), F.col("_to").isNotNull().alias("moved")).coalesce(tasks))
    return placed.filter("moved").drop("moved"), placed.select("node", "family")


def similarity_classes(docs: DataFrame, size: int = SIZE, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for every row of docs.

    class_id is the least doc_id of the class; n_links counts the other distinct sets that this document's set is
    linked with; n_copies counts the rows that share its set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = durable(sketch(docs, size))
    copies = durable(sets.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")))
    reps = copies.filter("rep IS NOT NULL").select(F.col("rep").alias("_rep"), F.col("set_key").alias("_key"))
    signed = sets.join(reps, (sets["set_key"] == reps["_key"]) & (sets["doc_id"] == reps["_rep"]), "left_semi")
    shortest = longest_prefix(threshold[0] / threshold[1], recall)
    near = durable(neighbours(forest(signed), shortest))
    nodes = near.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    candidates = durable(shingled(docs, nodes, size))
    tasks = pieces(candidates.count(), EACH, LEAST)  # for tables of a row or a few for each candidate
    families, linked, weakest, before, prefix = None, None, 1.0, DEPTH + 1, DEPTH
    while prefix < before:
        changed, families = joined_families(families, near.filter(F.col("level").between(prefix, before - 1)).select("u", "v"), tasks)
        found = durable(verify(candidates, changed, linked is None, tasks, threshold))
        linked = found if linked is None else linked.unionByName(found)
        least = found.agg(F.min("least")).first()[0]
        weakest = weakest if least is None else min(weakest, least)
        before, prefix = prefix, min(prefix, longest_prefix(weakest, recall))
    roots = components(linked.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    classes = (
        copies.join(roots, copies["rep"] == roots["node"], "left")
        .join(counts, copies["rep"] == counts["doc_id"], "left")
        .select(F.col("set_key").alias("_key"), F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    )
    classes = durable(classes)
    return sets.join(classes, sets["set_key"] == classes["_key"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_a_class(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, with all its columns: the least by (doc_id, hash of text), a null doc_id last.

    Rows are told apart by (doc_id, text), so neither null nor repeated doc_ids lose a text of their own; rows equal in
    both are one document, of which the least row stays. They are named by a 64-bit hash; should two of them share one,
    as their SHA-256 tells, both stay. Documents without words are never
    linked: with a null doc_id each row is one of its own. Columns must be sortable.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    rest = docs.filter(~own)
    key = F.xxhash64("doc_id", F.col("text").isNull(), "text")
    # Sums up in the tasks first, so that a row repeated very often costs its task one row for each other task.
    digest = F.sha2("text", 256)
    rows = rest.groupBy(key.alias("_key"), digest.alias("_digest")).agg(F.min(F.struct(*columns)).alias("_row"))
    keyed = rest.select(key.alias("doc_id"), "text")
    classes = similarity_classes(keyed, **how).select(F.col("doc_id").alias("_of"), "class_id").distinct()
    names = rest.select(key.alias("_name"), "doc_id", digest.alias("_text")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("_text"), F.col("_name"))
    stay = names.join(classes, F.col("_name") == F.col("_of")).groupBy("class_id").agg(F.min(order).alias("least")).select(F.col("least._name").alias("_stay"))
    shared = names.groupBy(F.col("_name").alias("_stay")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_stay")
    stay = stay.unionByName(shared)
    kept = rows.join(stay, F.col("_key") == F.col("_stay"), "left_semi").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return kept.unionByName(docs.filter(own))
