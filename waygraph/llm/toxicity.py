"""Toxicity by character n-grams scaled with naive Bayes log-count ratios.

A text is the set of its hashed character 3-, 4- and 5-grams.  Each is scaled by
the log ratio of its smoothed share among toxic and other training texts; the
scaled vector is brought to unit length and scored by a linear model fitted with
logistic loss.  The model is fitted on a bounded sample of labelled rows; scoring
reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import bounded_batches, held_out
from waygraph.plans.stages import table

BITS = 18
SIZES = (3, 4, 5)
#: At most so many labelled rows are used to fit, those with the smallest hash of their id.
SAMPLE = 3000


def gram_ids(text: str, flags: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text in lower case; ``flags`` is a scratch array of 2^BITS falses."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h, top = c, np.uint64(64 - BITS)
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n in SIZES:
            flags[(h * np.uint64(0x9E3779B97F4A7C15)) >> top] = True
    ids = np.flatnonzero(flags)
    flags[ids] = False
    return ids.astype(np.int32)


class Model:
    """Log-count ratios, weights on the scaled features and an intercept."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float):
        self.ratio, self.product, self.bias = ratio.astype(np.float32), (ratio * weight).astype(np.float32), bias

    def score(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        norm = float(np.sqrt((r * r).sum(dtype=np.float64)))
        z = self.bias + (float(self.product[ids].sum(dtype=np.float64)) / norm if norm else 0.0)
        return 1 / (1 + float(np.exp(-min(max(z, -50.0), 50.0))))


def fit(features: list[np.ndarray], labels: np.ndarray, epochs: int = 8, rate: float = 0.5, decay: float = 1e-3, least: int = 3) -> Model:
    """Ratios from counts with one added, n-grams of fewer than ``least`` texts left out; then AdaGrad on logistic loss."""
    d = 1 << BITS
    p, q = np.ones(d), np.ones(d)
    for ids, y in zip(features, labels, strict=True):
        (p if y else q)[ids] += 1
    ratio = np.where(p + q - 2 >= least, np.log((p / p.sum()) / (q / q.sum())), 0.0)
    n, pos = len(labels), float(np.sum(labels))
    weight, bias = np.zeros(d), float(np.log((pos + 1) / (n - pos + 1)))
    if not 0 < pos < n:
        return Model(ratio * 0, weight, bias)
    seen, seen_bias, order = np.full(d, 1e-8), 1e-8, np.random.default_rng(0)
    scaled = []
    for ids in features:
        r = ratio[ids]
        scaled.append((r / (np.linalg.norm(r) or 1.0)).astype(np.float32))
    for _ in range(epochs):
        for i in order.permutation(n):
            ids, v = features[i], scaled[i]
            w = weight[ids]
            z = bias + float(w @ v)
            g = 1 / (1 + np.exp(-min(max(z, -50.0), 50.0))) - labels[i]
            step = g * v + decay * w
            s = seen[ids] + step * step
            seen[ids] = s
            weight[ids] = w - rate * step / np.sqrt(s)
            seen_bias += g * g
            bias -= rate * g / np.sqrt(seen_bias)
    return Model(ratio, weight, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out.

    Only ids of the sample are broadcast and only n-gram ids of its texts reach
    the driver; both are bounded by ``sample``.  Null labels are skipped and
    of repeated label rows the smallest label counts.  Of rows that repeat an id
    the least n-gram ids count.  Without labels of both kinds, or without rows, the
    score is the smoothed share of toxic labels.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    rows = rows.groupBy("doc_id").agg(F.min(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        flags = np.zeros(1 << BITS, bool)
        return pd.Series([gram_ids(t, flags).tobytes() for t in texts])

    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), F.col("id") == F.col("doc_id"))
    own = own.select("id", "y", grams("text").alias("ids")).groupBy("id").agg(F.min("y").alias("y"), F.min("ids").alias("ids"))
    got = own.toPandas().sort_values("id")
    return fit([np.frombuffer(bytes(x), np.int32) for x in got["ids"]], got["y"].to_numpy())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` of the whole text, one row per row; a column of that name is replaced.

    Null is empty; equal texts have equal scores; texts of any length are read
    whole; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^BITS floats

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        flags = np.zeros(1 << BITS, bool)
        m = shared.value
        return pd.Series([m.score(gram_ids(t, flags)) for t in texts])

    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: toxicity of all documents."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
