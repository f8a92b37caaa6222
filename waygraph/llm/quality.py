"""Text quality by a generalised additive model with pairwise interactions.

Every text becomes a few numbers, each number a bin.  The model is a table of
scores for each feature and, for some pairs, a table over both features' bins.
Tables are learned by cyclic boosting: features take turns, each adding a shallow
tree on its bins fitted to the current gradient, at a small rate; then the pairs
with the largest remaining gain take turns with trees of one cut per axis.
Scoring adds table entries, vectorised over a batch.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import bounded_batches, held_out
from waygraph.plans.stages import materialise, table

FEATURES = ("log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "same_as_last", "short_words", "upper", "digits", "stops", "commas", "marks", "pipes", "symbols", "spaces", "wide", "line_length", "line_repeats", "line_stops", "entropy", "upper_words")
#: At most so many labelled rows are used to fit, those with the smallest hash of their id.
SAMPLE = 20_000
BINS = 32


def describe(text: str) -> list[float]:
    """The features of a text, in the order of FEATURES."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(data))
    h = np.bincount(data, minlength=256)
    words = text.split()
    k = max(1, len(words))
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    share = h[h > 0] / n
    ascii_marks = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        float(lens.mean()),
        float(lens.std()),
        len(counts) / k,
        max(counts.values(), default=0) / k,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        float((lens <= 3).sum()) / k,
        float(h[65:91].sum()) / n,
        float(h[48:58].sum()) / n,
        float(h[46]) / k,
        float(h[44]) / k,
        float(h[33] + h[63]) / k,
        float(h[124]) / k,
        float(ascii_marks - h[46] - h[44] - h[33] - h[63] - h[124]) / n,
        float(h[32] + h[10] + h[9]) / n,
        float(h[128:].sum()) / n,
        float(np.log1p(n / m)),
        1 - len(set(lines)) / m,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / m,
        float(-(share * np.log2(share)).sum()) if len(data) else 0.0,
        sum(map(str.isupper, words)) / k,
    ]


class Additive:
    """Bin edges, one table for each feature and one for each chosen pair."""

    def __init__(self, edges, bias, tables, pairs):
        self.edges, self.bias, self.tables, self.pairs = edges, bias, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree with at most ``leaves`` leaves over ordered bins: the Newton step of each bin's leaf."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, None)
        for s, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge) - cg[-1] ** 2 / (ch[-1] + ridge)
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], (s, a + c + 1))
        if best[1] is None:
            break
        s, cut = best[1]
        a, b = spans[s]
        spans[s : s + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts over two axes: its gain and the Newton step of each cell."""
    def corners(m):
        c = m.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        left, top, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, left - a, top - a, all_ - left - top + a

    parts = list(zip(corners(g), corners(h), strict=True))
    gain = sum(x**2 / (y + ridge) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    cells = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for cell, (x, y) in zip(cells, parts, strict=True):
        out[cell] = -x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0) -> Additive:
    """Cyclic boosting; with one class only, or no rows, the model is its smoothed share."""
    n, pos = len(y), float(np.sum(y))
    bias = float(np.log((pos + 1) / (n - pos + 1)))
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(f)]
    sizes = [len(e) + 1 for e in edges]
    model = Additive(edges, bias, [np.zeros(s) for s in sizes], {})
    if not 0 < pos < n:
        return model
    b = model.bins(x)
    z = np.full(n, bias)

    def gradients():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(f):
            g, h = gradients()
            step = rate * _tree(np.bincount(b[:, j], g, sizes[j]), np.bincount(b[:, j], h, sizes[j]), leaves, ridge)
            model.tables[j] += step
            z += step[b[:, j]]

    def both(i, j, g, h):
        flat = b[:, i] * sizes[j] + b[:, j]
        return [np.bincount(flat, v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for v in (g, h)]

    g, h = gradients()
    gains = sorted(((_quadrants(*both(i, j, g, h), ridge)[0], (i, j)) for i, j in combinations(range(f), 2) if sizes[i] > 1 and sizes[j] > 1), reverse=True)
    chosen = [p for _, p in gains[:pairs]]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = gradients()
            step = rate * _quadrants(*both(i, j, g, h), ridge)[1]
            model.pairs[i, j] += step
            z += step[b[:, i], b[:, j]]
    return model


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features``, one row per row of ``docs``; null text is empty, texts are read whole, an empty table gives none."""

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([describe(t) for t in texts])

    return docs.select("doc_id", described(F.coalesce("text", F.lit(""))).alias("features"))


def labelled(labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, y`` of at most ``sample`` labelled rows that are not held out.

    Null labels are skipped; of repeated label rows the smallest label counts.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    return y.groupBy("doc_id").agg(F.min(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def train(rows: DataFrame, y: DataFrame) -> Additive:
    """Fit on rows of ``doc_id, features`` that ``y`` labels; of rows that repeat an id the least features count."""
    own = rows.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("features").alias("features"))
    got = own.toPandas().sort_values("doc_id")  # at most as many rows as the sample of labels
    x = np.array([list(v) for v in got["features"]], np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(np.float64))


def score_features(model: Additive):
    """A function of the features column."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([list(v) for v in values], np.float64)))

    return score


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: quality of all documents."""
    bounded_batches(spark)
    rows = materialise(features(table(spark, sf_dir, "documents")), "quality-features")
    model = train(rows, labelled(table(spark, sf_dir, "labels")))
    out = rows.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score_features(model)("features").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns.

    Null text counts as empty; rows that repeat get the same score and stay or go
    together; texts are read whole.  Without labels of both kinds the score is the
    smoothed share of good labels.  An empty table gives an empty result.  Only
    texts that the sample of labels names are described before the fit.
    """
    bounded_batches(docs.sparkSession)
    y = labelled(labels)
    own = docs.select("doc_id", "text").join(F.broadcast(y.select("doc_id")), "doc_id")  # at most SAMPLE ids
    model = train(features(own), y)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([describe(t) for t in texts], np.float64).reshape(-1, len(FEATURES))))

    return docs.filter(score(F.coalesce("text", F.lit(""))) >= 0.5)
