"""Language identification by a byte convolutional network, trained in numpy.

Texts are read as UTF-8 bytes in consecutive windows of WINDOW bytes that together cover the whole text (the last is
padded with zero bytes). Filters of several widths slide over a window's bytes; each filter's response is a sum of one
learned number per byte value and place (a convolution over one-hot bytes). Every filter's largest response in the
window (max pooling, then ReLU) feeds a softmax over the languages; a document's probabilities are the mean of its
windows', weighted by their bytes.

The network is fitted to windows of a bounded sample of labelled rows: about PER_LANGUAGE documents of each language,
and IN_ALL at most of all together, chosen by a hash of doc_id and text, with up to WINDOWS_EACH windows of each. Every
label is learned as long as IN_ALL allows a document of each; beyond that the most frequent ones are (ties by name).
Fitting sees nothing but text and label; predicting sees nothing but text.

Null texts and texts without a letter are `und` with score 0, and so is every text if there is nothing to learn from.
Repeated rows get equal predictions. Null or rare labels are never predicted or are learned like any other. Other
columns are kept where names do not clash with the outputs, and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANGUAGE, IN_ALL = 1500, 20_000
WINDOWS_EACH = 4
STEPS = 500
BATCH = 256
UNKNOWN = "und"


@dataclass
class Model:
    """`tables[w]` has the shape (w, 256, FILTERS): the numbers of the filters of width w."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def respond(model: Model, x: np.ndarray, at: bool = False):
    """Largest responses of all filters in each window of x (n, WINDOW), and their places if asked for."""
    best, places = [], []
    for w, t in model.tables.items():
        m = x.shape[1] - w + 1
        r = t[0][x[:, :m]]
        for j in range(1, w):
            r += t[j][x[:, j : j + m]]
        if at:
            places.append(p := r.argmax(axis=1))
            best.append(np.take_along_axis(r, p[:, None, :], 1)[:, 0])
        else:
            best.append(r.max(axis=1))
    return (np.concatenate(best, 1), places) if at else np.concatenate(best, 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on the cross entropy of class-balanced batches. Gradients reach only the bytes that won the pooling."""
    g = np.random.default_rng(seed)
    k, hidden = len(languages), FILTERS * len(WIDTHS)
    tables = {w: g.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    model = Model(languages, tables, g.normal(0, 0.2, (hidden, k)).astype(np.float32), np.zeros(k, np.float32))
    params = [*tables.values(), model.out, model.bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by = [np.flatnonzero(y == c) for c in range(k)]
    for step in range(1, steps + 1):
        i = np.concatenate([g.choice(b, BATCH // k + 1) for b in by])
        xb, yb = x[i], y[i]
        pooled, places = respond(model, xb, at=True)
        h = np.maximum(pooled, 0)
        d = softmax(h @ model.out + model.bias)
        d[np.arange(len(i)), yb] -= 1
        d /= len(i)
        dh = (d @ model.out.T) * (pooled > 0)
        grads = []
        for n, w in enumerate(WIDTHS):
            gw, part, row = np.zeros_like(tables[w]), dh[:, n * FILTERS : (n + 1) * FILTERS], np.arange(len(i))[:, None]
            for j in range(w):
                np.add.at(gw[j], (xb[row, places[n] + j], np.arange(FILTERS)[None, :]), part)
            grads.append(gw)
        grads += [h.T @ d + 1e-4 * model.out, d.sum(0)]
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for p, gr, a, b in zip(params, grads, m1, m2, strict=True):
            a += 0.1 * (gr - a)
            b += 0.01 * (gr * gr - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return model


class Predictor:
    """The model with responses to all pairs of bytes tabled, so that a window needs few look-ups."""

    def __init__(self, model: Model):
        self.model = model
        t = model.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.two = {w: pair(t[w][0], t[w][1]) for w in WIDTHS}
        self.third = np.ascontiguousarray(t[3][2])
        self.last = pair(t[4][2], t[4][3])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for windows (n, WINDOW). Places come first in memory, so that pooling runs over whole rows."""
        x = np.ascontiguousarray(x.T)
        m = len(x)
        two = (x[:-1].astype(np.int32) << 8) | x[1:]
        take = lambda t, i: np.take(t, i, axis=0, mode="clip")
        r2 = take(self.two[2], two)
        r3 = take(self.two[3], two[: m - 2])
        r3 += take(self.third, x[2:])
        r4 = take(self.two[4], two[: m - 3])
        r4 += take(self.last, two[2:])
        pooled = np.concatenate([r.max(axis=0) for r in (r2, r3, r4)], 1)
        return softmax(np.maximum(pooled, 0) @ self.model.out + self.model.bias)


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of rows that lie joined in data; each one's row, and its bytes that are text."""
    size = np.diff(bounds)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[:-1][row] + k * WINDOW
    length = np.minimum(WINDOW, bounds[1:][row] - start)
    place = start[:, None] + np.arange(WINDOW)[None, :]
    inside = np.arange(WINDOW)[None, :] < length[:, None]
    x = np.where(inside, data[np.minimum(place, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)
    return x, row, length


def predict_batch(predictor: Predictor, texts: pa.Array, lettered: np.ndarray) -> pd.DataFrame:
    data, bounds = utf8(texts)
    k = len(predictor.model.languages)
    total = np.zeros((len(texts), k))
    for a, b in slices(bounds, 1 << 20):
        x, row, length = windows(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        for i in range(0, len(x), 64):  # few enough for their responses to stay in a core's cache
            p = predictor.probabilities(x[i : i + 64]) * length[i : i + 64, None]
            for c in range(k):
                total[a:b, c] += np.bincount(row[i : i + 64], p[:, c], b - a)
    size = np.maximum(1, np.diff(bounds))[:, None]
    share = total / size
    best = share.argmax(1)
    known = lettered & (np.diff(bounds) > 0)
    names = np.array(predictor.model.languages, dtype=object)
    return pd.DataFrame({"lang_pred": np.where(known, names[best], UNKNOWN), "score": np.where(known, np.minimum(1, share[np.arange(len(best)), best]), 0.0)})


def detect(text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score) of each whole text."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(model)
        for texts, lettered in batches:
            yield predict_batch(predictor, pa.Array.from_pandas(texts, type=pa.string()), lettered.to_numpy(dtype=bool))

    return apply(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def sample_windows(docs: DataFrame, per_language: int = PER_LANGUAGE, each: int = WINDOWS_EACH, in_all: int | None = None) -> DataFrame:
    """(lang, window) of about `per_language` documents of each language, fewer with very many, and of `in_all` at most.

    Documents are chosen by a hash of doc_id and text; rows that repeat both count once, so neither null nor repeated ids
    nor a text that fills the table can make the draw empty or large. At least one document of each language is drawn.
    """
    in_all = IN_ALL if in_all is None else in_all
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("sample"))
    part = F.shiftrightunsigned(key, 12) / float(1 << 52)
    labelled = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", key.alias("key"), part.alias("part"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.min("part").alias("least")).orderBy(F.desc("n"), "lang").limit(in_all).collect()
    share = min(per_language, in_all // max(1, len(counts)))
    upto = [(r["lang"], max(float(share) / max(1, r["n"]), r["least"])) for r in counts]
    known = docs.sparkSession.createDataFrame(upto, "lang string, upto double")
    near = labelled.join(F.broadcast(known), "lang").filter(F.col("part") <= F.col("upto"))  # a row for each language
    once = near.groupBy("lang", "key").agg(F.any_value("text").alias("text"), F.min(F.col("part") / F.greatest(F.col("upto"), F.col("part"))).alias("place"))
    chosen = once.orderBy("place", "lang", "key").limit(in_all)
    at = lambda i: F.pmod(F.xxhash64(F.col("key"), i), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), F.least(F.lit(each), F.ceil(F.length("text") / WINDOW).cast("int"))), lambda i: F.substring(F.col("text"), at(i), F.lit(WINDOW)))
    return chosen.select("lang", F.explode(cut).alias("window"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, steps: int = STEPS) -> Model | None:
    """Train on a bounded sample of docs (doc_id, text, lang); None where no row is labelled."""
    rows = sample_windows(docs, per_language).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "window"], kind="stable")  # tasks finish in any order
    languages = sorted(rows["lang"].unique())
    data = [w.encode()[:WINDOW] for w in rows["window"]]
    x = np.zeros((len(data), WINDOW), np.uint8)
    for i, d in enumerate(data):
        x[i, : len(d)] = np.frombuffer(d, np.uint8)
    y = np.searchsorted(languages, rows["lang"].to_numpy())
    return train(x, y, languages, steps)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, learned from those that are not held out."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))), per_language, steps)
    seen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), detect(F.col("text"), model).alias("p"))
    return seen.select("doc_id", "held_out", "p.lang_pred", "p.score")


#: A text in which no language reaches this probability is rejected.
LEAST_SCORE = 0.3


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in which a language is recognised, with all their columns; where there is nothing to learn from, all
    that hold a letter."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), detect(F.col("text"), model).alias("_p"))
    good = seen.filter((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= least))
    return good.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
