"""Symbolic laws: a search among expression trees for one that tells labels apart, or comes near to them.

A tree is a row: its tokens in prefix order. A generation's trees, of all folds, are scored in one pass over the channel
table: each task evaluates all of them on its rows and sends, for each tree, one short array of sums that add up over
tasks. Tournaments are joins on hashed draws; crossover and mutation are drawn from a hash of seed, generation, fold and
place, so that runs agree wherever their tasks run. Populations, and the number of folds, are parameters or groups of
structures and bounded; the rows of the channel table are not.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import significant
from ..functions.lineage import cut_lineage
from .graph import S


@dataclass(frozen=True)
class Primitive:
    """One function of `arity` arguments, three times: on arrays, on columns and in SQL."""

    arity: int
    array: Callable
    column: Callable
    sql: str


# The physics primitives, and the protected functions of the generic search.
SUMS = {
    "add": Primitive(2, np.add, lambda a, b: a + b, "({0} + {1})"),
    "sub": Primitive(2, np.subtract, lambda a, b: a - b, "({0} - {1})"),
    "mul": Primitive(2, np.multiply, lambda a, b: a * b, "({0} * {1})"),
}
PHYSICS = SUMS | {
    "sinlog": Primitive(1, lambda a: np.sin(np.log(np.abs(a) + 1e-6)), lambda a: F.sin(F.log(F.abs(a) + 1e-6)), "sin(ln(abs({0}) + 1e-6::DOUBLE))"),
    "thr": Primitive(1, lambda a: 1 / (1 + np.exp(-np.clip(4 * a, -30, 30))), lambda a: 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), 4.0 * a)))), "(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, 4.0::DOUBLE * {0})))))"),
    "interf": Primitive(2, lambda a, b: np.cos(a - b), lambda a, b: F.cos(a - b), "cos({0} - {1})"),
    "reso": Primitive(2, lambda a, b: np.exp(-np.minimum((a - b) ** 2, 30)), lambda a, b: F.exp(-F.least((a - b) * (a - b), F.lit(30.0))), "exp(-least(({0} - {1}) * ({0} - {1}), 30.0::DOUBLE))"),
}
GENERIC = SUMS | {
    "div": Primitive(2, lambda a, b: np.where(np.abs(b) > 0.001, a / np.where(np.abs(b) > 0.001, b, 1), 1.0), lambda a, b: F.when(F.abs(b) > 0.001, a / b).otherwise(1.0), "(CASE WHEN abs({1}) > 0.001::DOUBLE THEN {0} / {1} ELSE 1.0::DOUBLE END)"),
    "sqrt": Primitive(1, lambda a: np.sqrt(np.abs(a)), lambda a: F.sqrt(F.abs(a)), "sqrt(abs({0}))"),
    "log": Primitive(1, lambda a: np.where(np.abs(a) > 0.001, np.log(np.where(np.abs(a) > 0.001, np.abs(a), 1)), 0.0), lambda a: F.when(F.abs(a) > 0.001, F.log(F.abs(a))).otherwise(0.0), "(CASE WHEN abs({0}) > 0.001::DOUBLE THEN ln(abs({0})) ELSE 0.0::DOUBLE END)"),
    "abs": Primitive(1, np.abs, F.abs, "abs({0})"),
    "neg": Primitive(1, np.negative, lambda a: -a, "(-{0})"),
}
FUNCTIONS = PHYSICS | GENERIC
#: Constants are tokens that begin so.
CONSTANT = "#"


#: Channels that bear the name of a function are tokens that begin so.
CHANNEL = "$"


def channel(name: str) -> str:
    return CHANNEL + name if name in FUNCTIONS else name


def fold_up(tokens: list[str], leaf: Callable, call: Callable):
    """What a tree comes to, from its leaves and its calls `call(name, arguments)`."""
    stack: list = []
    for t in reversed(tokens):
        stack.append(call(t, [stack.pop() for _ in range(FUNCTIONS[t].arity)]) if t in FUNCTIONS else leaf(t))
    return stack[0]


def value(tokens: list[str], channels: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = fold_up(tokens, lambda t: float(t[1:]) if t[0] == CONSTANT else channels[t.removeprefix(CHANNEL)], lambda f, a: FUNCTIONS[f].array(*a))
    return np.nan_to_num(np.broadcast_to(np.asarray(out, float), (n,)), nan=0.0, posinf=1e300, neginf=-1e300)


def column(tokens: list[str]) -> Column:
    out = fold_up(tokens, lambda t: F.lit(float(t[1:])) if t[0] == CONSTANT else F.col(f"`{t.removeprefix(CHANNEL)}`"), lambda f, a: FUNCTIONS[f].column(*a))
    return F.nanvl(out.cast("double"), F.lit(0.0))


def to_sql(tokens: list[str]) -> str:
    return fold_up(tokens, lambda t: f"({t[1:]})::DOUBLE" if t[0] == CONSTANT else f'"{t.removeprefix(CHANNEL)}"', lambda f, a: FUNCTIONS[f].sql.format(*a))


def text(tokens: list[str]) -> str:
    return fold_up(tokens, lambda t: t.removeprefix(CONSTANT).removeprefix(CHANNEL), lambda f, a: f"{f}({', '.join(a)})")


def depth(tokens: list[str]) -> int:
    return fold_up(tokens, lambda t: 0, lambda f, a: 1 + max(a))


def end_of(tokens: list[str], at: int) -> int:
    """Where the subtree ends that begins at a token."""
    open_ = 1
    while open_:
        open_ += (FUNCTIONS[tokens[at]].arity if tokens[at] in FUNCTIONS else 0) - 1
        at += 1
    return at


# Trees by hashed draws


@dataclass(frozen=True)
class Search:
    """The settings of a search. Children longer than `longest` are put aside for their parents."""

    functions: tuple[str, ...]
    metric: str = "auc"
    population: int = 300
    generations: int = 15
    contenders: int = 8
    parsimony: float = 0.0008
    crossover: float = 0.7
    subtree: float = 0.12
    hoist: float = 0.05
    point: float = 0.1
    longest: int = 40
    seed: int = 0


# Shares of the two searches.
LAW_SEARCH = Search(tuple(PHYSICS))
GENERIC_SEARCH = Search(tuple(GENERIC), metric="mae", parsimony=0.01, subtree=0.1)


def grown(g: random.Random, s: Search, cols: list[str], levels: int, full: bool) -> list[str]:
    """A random tree of at most so many levels, or of just so many."""
    if levels == 0 or (not full and g.random() < 0.3):
        return [f"{CONSTANT}{g.uniform(-1, 1):.3f}"] if g.random() < 1 / (len(cols) + 1) else [channel(g.choice(cols))]
    f = g.choice(s.functions)
    return [f, *(t for _ in range(FUNCTIONS[f].arity) for t in grown(g, s, cols, levels - 1, full))]


def first_tree(g: random.Random, s: Search, cols: list[str]) -> list[str]:
    t = grown(g, s, cols, g.randint(1, 4), g.random() < 0.5)
    return t if len(t) <= s.longest else t[(at := 1) : end_of(t, at)]


def picked(g: random.Random, tokens: list[str]) -> tuple[int, int]:
    """A subtree: nine times of ten one that begins in a function, where there is any."""
    calls = [k for k, t in enumerate(tokens) if t in FUNCTIONS]
    a = g.choice(calls) if calls and g.random() < 0.9 else g.randrange(len(tokens))
    return a, end_of(tokens, a)


def child(g: random.Random, s: Search, cols: list[str], parent: list[str], donor: list[str]) -> list[str]:
    u = g.random()
    a, z = picked(g, parent)
    if u < s.crossover:
        b, y = picked(g, donor)
        out = [*parent[:a], *donor[b:y], *parent[z:]]
    elif (u := u - s.crossover) < s.subtree:
        out = [*parent[:a], *grown(g, s, cols, g.randint(1, 3), g.random() < 0.5), *parent[z:]]
    elif (u := u - s.subtree) < s.hoist:
        b, y = picked(g, inner := parent[a:z])
        out = [*parent[:a], *inner[b:y], *parent[z:]]
    elif u - s.hoist < s.point:
        out = [_other(g, s, cols, t) if g.random() < 0.15 else t for t in parent]
    else:
        out = parent
    return list(out) if len(out) <= s.longest else list(parent)


def _other(g: random.Random, s: Search, cols: list[str], token: str) -> str:
    """A token of the same arity."""
    if token in FUNCTIONS:
        return g.choice([f for f in s.functions if FUNCTIONS[f].arity == FUNCTIONS[token].arity])
    if token[0] == CONSTANT:
        return f"{CONSTANT}{float(token[1:]) + g.gauss(0, 0.3):.3f}"
    return channel(g.choice(cols))


# Scores as sums over tasks

#: Scores are counted in so many ranges of each tree's values; their bounds come from a sample of rows, the counts from all.
BINS, SAMPLE = 128, 1000


def auc_sums(v: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Negatives, then positives, in each range of values."""
    at = np.searchsorted(bounds, v, "left")
    return np.bincount(at + BINS * (y > 0), minlength=2 * BINS).astype(float)


def auc_of(sums: np.ndarray) -> np.ndarray:
    """AUC of rows of `auc_sums`, values of one range counting as ties; 0.5 where a class is empty."""
    neg, pos = sums[:, :BINS], sums[:, BINS:]
    both = neg.sum(1) * pos.sum(1)
    won = (pos * (np.cumsum(neg, 1) - neg / 2)).sum(1)
    return np.where(both > 0, won / np.where(both > 0, both, 1), 0.5)


def error_sums(v: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    far, pos = np.abs(v - y), y > 0
    return np.array([far[~pos].sum(), far[pos].sum(), (~pos).sum(), pos.sum()], float)


def error_of(sums: np.ndarray) -> np.ndarray:
    """Mean absolute error with classes weighted alike, negated."""
    weight = np.maximum(1, sums[:, 2]) / np.maximum(1, sums[:, 3])
    return -(sums[:, 0] + weight * sums[:, 1]) / np.maximum(1, sums[:, 2] + weight * sums[:, 3])


METRICS = {"auc": (auc_sums, auc_of), "mae": (error_sums, error_of)}


def scored(x: DataFrame, cols: list[str], trees: DataFrame, sample: pd.DataFrame, s: Search) -> DataFrame:
    """trees (fold, place, tokens) with their fitness on the rows of all other folds: one pass over x (fold, y01, channels).

    The population is held by every task; a task sends one array a tree, and arrays are summed where a tree is dealt to.
    """
    sums_of, fitness_of = METRICS[s.metric]
    held = [(r["fold"], r["place"], list(r["tokens"])) for r in trees.collect()]  # bounded: the population of each fold
    at = {c: sample[c].to_numpy(float) for c in cols}
    bounds = [np.quantile(value(t, at, len(sample)), np.arange(1, BINS) / BINS) if s.metric == "auc" and len(sample) else np.zeros(0) for _, _, t in held]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            y, own = pdf["y01"].to_numpy(float), pdf["fold"].to_numpy()
            channels, others = {c: pdf[f"c{j}"].to_numpy(float) for j, c in enumerate(cols)}, {}
            with np.errstate(all="ignore"):
                for k, (fold, _, tokens) in enumerate(held):
                    if fold not in others:
                        others[fold] = np.flatnonzero(own != fold)
                    v = value(tokens, channels, len(pdf))[others[fold]]
                    part = sums_of(v, y[others[fold]], bounds[k])
                    total = np.zeros((len(held), len(part))) if total is None else total
                    total[k] += part
        if total is not None:
            yield pd.DataFrame({"tree": np.arange(len(held), dtype=np.int32), "sums": [t.tobytes() for t in total]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, part in zip(pdf["tree"], pdf["sums"], strict=True):
                part = np.frombuffer(part)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            of = [held[k] for k in sums]
            length = np.array([len(t) for _, _, t in of])
            fitness = fitness_of(np.stack(list(sums.values()))) - s.parsimony * length
            yield pd.DataFrame({"fold": [f for f, _, _ in of], "place": [p for _, p, _ in of], "tokens": [t for _, _, t in of], "fitness": np.round(fitness, 9)})

    parts = x.select("fold", "y01", *[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(cols)]).mapInPandas(count, "tree int, sums binary")
    return parts.repartition("tree").mapInPandas(total, "fold string, place int, tokens array<string>, fitness double")


def next_generation(ranked: DataFrame, cols: list[str], generation: int, s: Search) -> DataFrame:
    """The children of scored trees: each place draws its contenders for parent and donor by a hash; place 0 keeps the best."""
    places = ranked.select("fold", "place")
    draw = lambda who: F.transform(F.sequence(F.lit(1), F.lit(s.contenders)), lambda k: F.pmod(F.xxhash64("fold", "place", k, F.lit(f"{s.seed}:{generation}:{who}")), F.lit(s.population)).cast("int"))
    drawn = places.select("fold", "place", F.explode(F.array(*[F.struct(F.lit(w).alias("who"), draw(w).alias("c")) for w in ("parent", "donor")])).alias("d"))
    drawn = drawn.select("fold", "place", "d.who", F.explode("d.c").alias("contender"))
    theirs = ranked.select(F.col("fold").alias("of"), F.col("place").alias("contender"), "tokens", "fitness")
    merit = F.struct("fitness", -F.size("tokens"), -F.col("contender"))
    won = drawn.join(theirs, (F.col("fold") == F.col("of")) & (drawn.contender == theirs.contender)).drop(drawn.contender)
    pairs = won.groupBy("fold", "place").agg(*[F.max_by(F.when(F.col("who") == w, F.col("tokens")), F.when(F.col("who") == w, merit)).alias(w) for w in ("parent", "donor")])
    best = ranked.groupBy(F.col("fold").alias("of")).agg(F.max_by("tokens", F.struct("fitness", -F.size("tokens"), -F.col("place"))).alias("best"))

    def breed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [list(r.best) if r.place == 0 else child(random.Random(f"{s.seed}:{generation}:{r.fold}:{r.place}"), s, cols, list(r.parent), list(r.donor)) for r in pdf.itertuples()]
            yield pd.DataFrame({"fold": pdf["fold"], "place": pdf["place"], "tokens": tokens})

    return pairs.join(F.broadcast(best), F.col("fold") == F.col("of")).drop("of").mapInPandas(breed, "fold string, place int, tokens array<string>")  # a row for each fold


def search(x: DataFrame, cols: list[str], s: Search = LAW_SEARCH, hold_out: bool = True) -> DataFrame:
    """(fold, tokens, fitness): the fittest tree of each fold, learned from the rows of all others; ties to the shorter, then by text.

    A fold is a group of structures, named by what comes before a '.' in their names. Without holding out there is one
    law, of the fold '', learned from all rows.
    """
    spark = x.sparkSession
    rows = cut_lineage(x.select(F.substring_index(S, ".", 1).alias("fold"), "node_id", F.col("y01").cast("double").alias("y01"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]))
    folds = [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()] if hold_out else [""]  # groups, not structures
    sample = rows.orderBy(F.xxhash64("fold", "node_id", F.lit(s.seed)), "fold", "node_id").limit(SAMPLE).toPandas()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fold, place = [folds[k // s.population] for k in pdf["id"]], [int(k % s.population) for k in pdf["id"]]
            yield pd.DataFrame({"fold": fold, "place": place, "tokens": [first_tree(random.Random(f"{s.seed}:0:{f}:{p}"), s, cols) for f, p in zip(fold, place, strict=True)]})

    trees = cut_lineage(spark.range(len(folds) * s.population).mapInPandas(first, "fold string, place int, tokens array<string>"))
    ranked = trees.withColumn("fitness", F.lit(None).cast("double"))
    for generation in range(1, s.generations + 1):
        ranked = cut_lineage(scored(rows, cols, trees, sample, s))
        if generation < s.generations:
            trees = cut_lineage(next_generation(ranked, cols, generation, s))
    merit = F.struct("fitness", -F.size("tokens"), F.concat_ws(" ", "tokens"))
    return ranked.groupBy("fold").agg(F.max_by("tokens", merit).alias("tokens"), F.max("fitness").alias("fitness"))


def applied(x: DataFrame, laws: DataFrame) -> DataFrame:
    """(structure_id, node_id, y01, law, score): every row's value under its own fold's law, as one expression of columns."""
    held = laws.select("fold", "tokens").collect()  # a row for each group of structures
    fold = F.substring_index(S, ".", 1)
    score, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for r in held:
        own = (fold == r["fold"]) | F.lit(r["fold"] == "")
        score = F.when(own, column(list(r["tokens"]))).otherwise(score)
        name = F.when(own, text(list(r["tokens"]))).otherwise(name)
    return x.select(S, "node_id", "y01", name.alias("law"), significant(score).alias("score"))
