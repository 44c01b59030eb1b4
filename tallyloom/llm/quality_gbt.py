"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are quantised to at most ``BINS`` quantile bins; each level of a tree takes, for every node,
the split of most gain from gradient and hessian histograms. Trees are complete to ``DEPTH`` and are
kept as flat arrays (feature, threshold, leaf), so that a batch of documents walks all trees as array
indexing: node = 2 * node + 1 + (x > threshold).

The model is fitted on at most ``common.FIT_ROWS`` labelled documents (a documented bound), whose
statistics Spark computes; only these rows of numbers come to the driver. Scoring is one pass over
all whole texts.

Defined results: null and empty texts have zero statistics and are scored like any other; without
usable labels every score is 0.5, with labels of one class their smoothed share; repeated rows get
equal scores; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import common, text_stats

TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 80, 4, 64, 0.15, 1.0, 5


@dataclass(frozen=True)
class Trees:
    """A fitted ensemble: arrays of shape (trees, 2**depth - 1) and leaves of shape (trees, 2**depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosting of the logistic loss on rows ``x`` with labels ``y`` in {0, 1}."""
    n, width = x.shape
    inner = 2**depth - 1
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    feature, threshold, leaf = [], [], []
    if n and 0 < y.sum() < n:
        quantiles = np.quantile(x, np.linspace(0, 1, bins), axis=0)
        cuts = []
        for f in range(width):
            q = np.unique(quantiles[:, f])
            cuts.append((q[1:] + q[:-1]) / 2)
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1)
        flat = binned + np.arange(width) * bins  # one histogram for all features
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            own_f, own_t = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (width * bins) + flat).ravel()
                size = count * width * bins
                hist = [np.bincount(at, np.repeat(v, width), size).reshape(count, width, bins) for v in (g, h, np.ones(n))]
                left = [np.cumsum(v, 2)[:, :, :-1] for v in hist]
                whole = [v.sum(2)[:, :, None] for v in hist]
                gain = left[0] ** 2 / (left[1] + L2) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + L2) - whole[0] ** 2 / (whole[1] + L2)
                gain[(left[2] < MIN_ROWS) | (whole[2] - left[2] < MIN_ROWS)] = 0
                best = gain.reshape(count, -1).argmax(1)
                for k in range(count):
                    f, b = divmod(int(best[k]), bins - 1)
                    if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                        own_f[first + k], own_t[first + k] = f, cuts[f][b]
                node = 2 * node + 1 + (x[np.arange(n), own_f[node]] > own_t[node])
            at = node - inner
            values = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
            margin += values[at]
            feature.append(own_f)
            threshold.append(own_t)
            leaf.append(values)
    shape = (len(feature), inner)
    return Trees(base, np.array(feature, np.int64).reshape(shape), np.array(threshold, float).reshape(shape), np.array(leaf, float).reshape(len(leaf), inner + 1))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts):
    return texts.map(lambda t: text_stats.statistics(t or ""))


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = common.FIT_ROWS) -> Trees:
    """Trees from at most ``bound`` labelled documents whose labels may be used."""
    rows = common.labelled_sample(docs, labels, "quality", bound).select("doc_id", "y", _statistics("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(text_stats.NAMES))
    return train(x, np.array([r["y"] == 1 for r in rows], float))


def score(model: Trees) -> Column:
    """A function of a text column: the probability of label 1."""

    @F.pandas_udf(T.DoubleType())
    def run(texts):
        import pandas as pd

        x = np.array([text_stats.statistics(t or "") for t in texts], float).reshape(-1, len(text_stats.NAMES))
        return pd.Series(model.scores(x))

    return run


def score_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.select("doc_id", (~common.learnable(F.col("doc_id"))).alias("held_out"), score(model)("text").alias("score"))
    return own.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
