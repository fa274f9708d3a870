"""Quality scores by Bradley-Terry ranking of preference pairs.

Each pair holds a text labelled good and one labelled bad; all such pairs count. The
logistic loss on the difference of their features gives the weights of a linear score;
the score quantile at the share of bad texts is the threshold.

Pairs are not formed: texts are summed by class and narrow bins of their present score,
and the bins are paired. So a step of Newton's method takes two passes over the labelled
texts, and the driver holds sums of a fixed size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import text_stats as S
from .labelled import known_labels
from .storage import discard, materialize

#: Bins of each feature; a bin holds a weight of its own, so scores need not be linear in a feature.
BINS = 8
#: Feature values are counted in steps of 1 / GRID, up to REACH on either side.
GRID, REACH = 4096, 8
#: Bins of scores, in which texts of a class are paired as one.
SCORE_BINS = 512
#: Most steps of the fit, and the gradient at which it ends.
STEPS, SMALL = 20, 1e-6


def pair_loss(w: np.ndarray, diff: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of preferring the better text of each pair, with weight decay, and its gradient; ``diff``: better less worse features."""
    margin = np.clip(diff @ w, -50, 50)
    loss = float(np.logaddexp(0, -margin).mean() + ridge / 2 * (w @ w))
    return loss, ridge * w - diff.T @ (1 / (1 + np.exp(margin))) / len(diff)


@dataclass
class Ranking:
    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Where each feature lies, as one column per feature and bin edge passed."""
        return (x[:, :, None] > self.edges[None]).reshape(len(x), -1).astype(float)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = self.bins(x) @ self.weights
        return 1 / (1 + np.exp(-np.clip((score - self.threshold) / self.spread, -50, 50)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bad_share: float, ridge: float = 1e-3) -> Ranking:
        """The ranking of texts that are at hand."""
        return learnt(x.shape[1], lambda: grid_counts(x), lambda m: m.sums(x, y), lambda m, a: m.squares(x, y, a), bad_share, ridge)

    def ends(self) -> tuple[float, float]:
        """Bounds of the scores."""
        return float(np.minimum(self.weights, 0).sum()), float(np.maximum(self.weights, 0).sum())

    def _placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = self.bins(x)
        low, high = self.ends()
        return b, np.clip((b @ self.weights - low) / max(high - low, 1e-12) * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By class and bin of scores: the number of texts, and the sums of their columns."""
        b, place = self._placed(x)
        out = np.zeros((2 * SCORE_BINS, 1 + b.shape[1]))
        np.add.at(out, y * SCORE_BINS + place, np.concatenate([np.ones((len(b), 1)), b], axis=1))
        return out.reshape(2, SCORE_BINS, -1)

    def squares(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sum of products of columns, each text weighed by its class and bin of scores."""
        b, place = self._placed(x)
        return b.T @ (b * weight[y, place][:, None])


def grid_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, value on the grid, and how many texts have it."""
    value = np.floor(np.clip(x, -REACH, REACH) * GRID).astype(np.int64)
    key, n = np.unique(value + REACH * GRID + np.arange(x.shape[1]) * (2 * REACH * GRID + 1), return_counts=True)
    return key // (2 * REACH * GRID + 1), key % (2 * REACH * GRID + 1) - REACH * GRID, n


def all_pairs(w: np.ndarray, sums: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`pair_loss` and its gradient over all pairs, from :meth:`Ranking.sums`; then what its second derivative weighs each bin's squares with, and takes from them."""
    (n0, m0), (n1, m1) = ((part[part[:, 0] > 0][:, 0], part[part[:, 0] > 0][:, 1:]) for part in sums)
    margin = np.clip((m1 @ w / n1)[:, None] - (m0 @ w / n0)[None], -50, 50)
    pairs = n1.sum() * n0.sum()
    miss = 1 / (1 + np.exp(margin))
    loss = float(n1 @ np.logaddexp(0, -margin) @ n0 / pairs + ridge / 2 * (w @ w))
    grad = ridge * w - ((miss @ n0) @ m1 - (n1 @ miss) @ m0) / pairs
    curve = miss * (1 - miss) / pairs
    weight = np.zeros(sums.shape[:2])
    weight[0, sums[0, :, 0] > 0], weight[1, sums[1, :, 0] > 0] = n1 @ curve, curve @ n0
    cross = m1.T @ curve @ m0
    return loss, grad, weight, cross + cross.T


def learnt(size: int, counts: Callable, sums: Callable, squares: Callable, bad_share: float, ridge: float = 1e-3) -> Ranking:
    """A ranking of ``size`` features by Newton's method, from passes over all texts: counts on the grid, and :meth:`Ranking.sums` and :meth:`Ranking.squares` of a model."""
    model = Ranking(np.zeros((size, BINS - 1)), np.zeros(size * (BINS - 1)), 0.0, 1.0)
    feature, value, n = counts()
    for k in range(size if len(n) else 0):
        v, m = value[feature == k], n[feature == k]
        order = np.argsort(v)
        passed = np.cumsum(m[order])
        at = np.searchsorted(passed, np.linspace(0, 1, BINS + 1)[1:-1] * passed[-1])
        model.edges[k] = (v[order][at] + 1) / GRID - 1e-9
    found = sums(model)
    if not found[0, :, 0].sum() or not found[1, :, 0].sum():
        return Ranking(np.zeros_like(model.edges), model.weights, 0.0, 1.0)
    loss, grad, weight, cross = all_pairs(model.weights, found, ridge)
    for _ in range(STEPS):
        if np.abs(grad).max() < SMALL:
            break
        way = np.linalg.solve(squares(model, weight) - cross + ridge * np.eye(len(grad)), grad)
        for half in range(6):
            tried = Ranking(model.edges, model.weights - way / 2**half, 0.0, 1.0)
            tried_sums = sums(tried)
            now = all_pairs(tried.weights, tried_sums, ridge)
            if now[0] < loss:
                break
        else:
            break
        gained, model, found, (loss, grad, weight, cross) = loss - now[0], tried, tried_sums, now
        if gained < SMALL:
            break
    n = found[:, :, 0]
    share = (n[0] / n[0].sum() * bad_share + n[1] / n[1].sum() * (1 - bad_share)).cumsum()
    low, high = model.ends()
    at = min(int(np.searchsorted(share, bad_share)), SCORE_BINS - 1)
    before = share[at - 1] if at else 0.0
    part = min(1.0, (bad_share - before) / max(share[at] - before, 1e-12))
    model.threshold = low + (high - low) * (at + part) / SCORE_BINS
    middle = low + (high - low) * (np.arange(SCORE_BINS) + 0.5) / SCORE_BINS
    total = n.sum(axis=0)
    mean = (total @ middle) / total.sum()
    model.spread = float(max(1e-6, np.sqrt(total @ (middle - mean) ** 2 / total.sum()) / 4))
    return model


#: Features of a text.
SIZE = len(S.FEATURES) + 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in K.slices(batch.column(1)):
            flat = pa.array(S.text_features(s).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), K.list_array(flat, np.arange(s.n + 1) * SIZE)], names=["doc_id", "x"])


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)``: the features of every text."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(K.released(_features), "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in grid_counts(_matrix(batch))], names=["feature", "value", "n"])


def _summed(of: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = of(_matrix(batch), y)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    return run


def _total(labelled: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sums over all labelled texts, combined by a tree of tasks."""
    parts = labelled.mapInArrow(K.released(_summed(of)), "sums binary").rdd.map(lambda r: pickle.loads(r.sums))
    return parts.treeAggregate(np.zeros(shape), lambda a, b: a + b, lambda a, b: a + b, 2 if parts.getNumPartitions() < 10_000 else 3)


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Ranking:
    """A ranking fitted on all texts that ``labels.quality`` knows, from :func:`features`; the share of bad texts is that of all labels."""
    known = known_labels(labels, "quality", id_col)
    bad_share = known.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    labelled = materialize(features.join(known, "doc_id").select("label", "x"), "labelled")

    def counts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = labelled.mapInArrow(K.released(_counted), "feature long, value long, n long").groupBy("feature", "value").agg(F.sum("n").alias("n")).toArrow()
        return tuple(rows.column(c).to_numpy() for c in ("feature", "value", "n"))

    columns = SIZE * (BINS - 1)
    model = learnt(
        SIZE,
        counts,
        lambda m: _total(labelled, m.sums, (2, SCORE_BINS, 1 + columns)),
        lambda m, a: _total(labelled, lambda x, y: m.squares(x, y, a), (columns, columns)),
        bad_share or 0.0,
    )
    discard(labelled)
    return model


def _score(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(_matrix(batch)))], names=["doc_id", "score"])

    return run


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Ranking | None = None) -> DataFrame:
    """``(doc_id, score)`` in 0 to 1 for every row; 0.5 is the threshold.

    Null and empty texts are scored by their empty features. Repeated rows are
    scored each; an empty table gives no rows; other columns are ignored. Without
    labels of both classes every score is 0.5.
    """
    found = features(documents, id_col, text_col)
    if model is None:
        found = materialize(found, "features")  # read by the fit and by the scores
        model = fit(found, labels, id_col)
    return found.mapInArrow(K.released(_score(model)), "doc_id long, score double")
