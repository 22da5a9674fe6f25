"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text gets a lookup table over its bins, some pairs of features a table over
pairs of bins; a score is the logistic of the tables' sum. The tables are learned by cyclic
gradient boosting: round after round, feature after feature, a shallow tree is fitted to the
current gradients of that feature's bins alone and a small step of it is added to the table.
Pairs are ranked by what a four-cell split of the remaining gradients gains, then boosted the
same way. Scoring adds up vectorised table look-ups.

The fit uses at most ``MAX_FIT_ROWS`` labelled rows, taken in the order of a hash of doc_id
(a bound on labelled rows only; every document is scored).

Nulls and edge cases: a null text counts as empty and is scored; labels that are null or whose
document is unknown are not learned from; of several labels of a document the larger counts;
repeated documents are scored each; with no usable label, or labels of one kind, every score is
the share of label 1 among them (0.5 without any); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.shared import let_go, only, slices, written
from noteloom.llm.text_features import NAMES, features

MAX_FIT_ROWS = 30_000
BINS, PAIR_BINS = 48, 12


def _tree(grad: np.ndarray, hess: np.ndarray, splits: int, least: float = 8.0) -> np.ndarray:
    """Leaf values over a row of bins of a tree with at most ``splits`` splits, grown by gain."""
    g, h = np.append(0.0, np.cumsum(grad)), np.append(0.0, np.cumsum(hess))
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    def best(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        cut = cut[(h[cut] - h[a] >= least) & (h[b] - h[cut] >= least)]
        if not len(cut):
            return 0.0, -1
        gains = score(a, cut) + score(cut, b) - score(a, b)
        i = int(np.argmax(gains))
        return float(gains[i]), int(cut[i])

    leaves = [(0, len(grad))]
    for _ in range(splits):
        found = [(*best(a, b), a, b) for a, b in leaves]
        gain, cut, a, b = max(found)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, cut), (cut, b)]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """Best tree with one cut on either feature over a table of bin pairs: (gain, leaf values)."""
    g = np.zeros((grad.shape[0] + 1, grad.shape[1] + 1))
    h = np.zeros_like(g)
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    G, H = g[1:-1, 1:-1], h[1:-1, 1:-1]
    top_g, top_h, left_g, left_h = g[1:-1, -1:], h[1:-1, -1:], g[-1:, 1:-1], h[-1:, 1:-1]
    cells = [(G, H), (top_g - G, top_h - H), (left_g - G, left_h - H), (g[-1, -1] - top_g - left_g + G, h[-1, -1] - top_h - left_h + H)]
    gain = sum(a**2 / (b + 1.0) for a, b in cells) - g[-1, -1] ** 2 / (h[-1, -1] + 1.0)
    gain[np.min([b for _, b in cells], axis=0) < least] = 0
    if gain.size == 0 or gain.max() <= 1e-9:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(grad)
    for (a, b), rows, cols in zip(cells, (slice(None, i + 1), slice(None, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(None, j + 1), slice(j + 1, None)) * 2):
        out[rows, cols] = a[i, j] / (b[i, j] + 1.0)
    return float(gain.max()), out


@dataclass
class Gam:
    """Edges, tables and pair tables; ``scores`` works on rows of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        for k, table in enumerate(self.tables):
            z += table[bins[k]]
        for a, b, table in self.pairs:
            z += table[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 40) -> Gam:
    share = float(y.mean()) if len(y) else 0.5
    clipped = min(max(share, 1e-6), 1 - 1e-6)
    model = Gam(base=float(np.log(clipped / (1 - clipped))))
    if len(y) == 0 or share in (0.0, 1.0):
        return model
    n, m = x.shape
    for k in range(m):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest"))
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
        model.coarse.append(np.minimum(np.arange(len(cuts) + 1) * PAIR_BINS // (len(cuts) + 1), PAIR_BINS - 1))
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    z = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(m):
            g, h = slopes()
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), splits=3)
            model.tables[k] += step
            z += step[bins[k]]
    coarse = [c[b] for c, b in zip(model.coarse, bins)]

    def table(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * PAIR_BINS + coarse[b], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    ranked = sorted(((_cross(table(a, b, g), table(a, b, h))[0], a, b) for a in range(m) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, a, b in ranked[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, t in model.pairs:
            g, h = slopes()
            step = rate * _cross(table(a, b, g), table(a, b, h))[1]
            t += step
            z += step[coarse[a], coarse[b]]
    return model


def feature_table(documents: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, 2000):
            x = features(batch.column(1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "x"])

    return only(documents, "doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` modulo ``folds``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_quality(table: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Gam:
    """Fit on labelled rows outside the held-out fold (crc32 modulo 5 is 0), at most ``max_rows`` of them."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(~held_out(F.col("doc_id"), 5, 0))
    rows = table.join(known, "doc_id").select("x", "y", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(max_rows).select("x", "y").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(NAMES)) if len(y) else np.zeros((0, len(NAMES)), np.float32)
    return fit(x, (y > 0).astype(float))


def score_table(table: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of a feature table."""
    spark = table.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.scores(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Score every document: (doc_id, held_out, score, predicted)."""
    table = written(feature_table(documents), "quality-features")
    return score_table(table, fit_quality(table, labels, max_rows=max_rows), threshold)
