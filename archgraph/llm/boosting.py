"""A quality classifier: histogram gradient-boosted trees over document statistics.

Features are cut at quantiles into bins; trees grow level by level from histograms of gradients; a full tree of depth D
is three flat arrays (feature, threshold, value) in which the children of node i are 2i + 1 and 2i + 2, so a batch
descends all trees at once with array look-ups. Fitted on at most SAMPLE_ROWS labelled rows that are not held out, those of
least hash; every document is scored.

Cases: a very long text is one row of its batch and read whole; of equal gains the first feature and bin split; of rows that repeat an id one
is learned from, all are scored; null and empty texts have the statistics of no words and get a score like any other; NaN cannot occur; with no
labels, or one class alone, the score is the prior for all; repeated rows get equal scores; an empty table gives no rows; a kept
column that has the result's name is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import appended, labelled_sample, text_chunks
from archgraph.llm.statistics import DOCUMENT_FEATURES, document_features

SAMPLE_ROWS, BINS, DEPTH, TREES, RATE, RIDGE, LEAST_ROWS = 20_000, 64, 4, 80, 0.15, 2.0, 8
THRESHOLD = 0.7


@dataclass(frozen=True)
class Trees:
    prior: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.prior + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on log loss; gains and leaves are Newton steps with a ridge."""
    n, width = x.shape if len(x) else (0, len(DOCUMENT_FEATURES))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    mean = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    prior = float(np.log(mean / (1 - mean)))
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    if not n or y.min() == y.max():
        return Trees(prior, feature, threshold, value)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    slots = binned + BINS * np.arange(width)
    margin = np.full(n, prior)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            base, count = 2**level - 1, 2**level
            flat = ((node - base)[:, None] * (width * BINS) + slots).ravel()
            hist = [np.bincount(flat, np.repeat(w, width), count * width * BINS).reshape(count, width, BINS).cumsum(axis=2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = hist, (a[:, :, -1:] for a in hist)
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9:
                    feature[t, base + k], threshold[t, base + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[t, leaf]
    return Trees(prior, feature, threshold, value)


def features(column: pa.Array) -> np.ndarray:
    parts = [document_features(data, offs) for _, _, data, offs in text_chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(DOCUMENT_FEATURES)))


def fitted(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    sample = labelled_sample(documents, labels, rows)

    def start():
        return lambda column: [pa.array(list(features(column)), pa.list_(pa.float64()))]

    got = appended(sample, "text", {"x": "array<double>"}, start, ("doc_id", "quality")).orderBy("doc_id").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(DOCUMENT_FEATURES))
    return fit(x, got["quality"].to_numpy().astype(np.float64))


def score(df: DataFrame, trees: Trees, text: str = "text", keep: tuple[str, ...] | None = None, output: str = "score") -> DataFrame:
    """The frame's columns (or `keep`) and the score."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def start():
        return lambda column: [pa.array(shared.value.score(features(column)), pa.float64())]

    return appended(df, text, {output: "double"}, start, keep)


def predicted(column: str = "score", threshold: float = THRESHOLD):
    return F.when(F.col(column) >= threshold, 1).otherwise(0)
