"""Quality rules by line labelling with a linear-chain conditional random field.

Every line is content or boilerplate. Labels are known for texts only, so the labels
of lines are latent: a text of good quality is one whose content lines hold at least
the wanted share of its words. Rounds of fitting and labelling alternate: the field is
fitted to the current labels of lines, then each line takes its label on the best path,
and in a text whose share contradicts its label the least certain lines change sides.
In the first round, where all lines of a text carry its label, lines count singly:
moves between labels are learnt only once labels differ within texts.
Decoding is Viterbi over all lines of a text, and the share of words in content lines
decides retention.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import text_stats as S
from .labelled import labelled_sample

#: Labelled texts of each class, and chains of their lines, that the field is fitted on; lines of a chain.
SAMPLE_TEXTS, SAMPLE_LINES = 1500, 100
#: Least share of a kept text's words in content lines.
CONTENT_SHARE = 0.5
#: Most repeated words in a hundred, and fewest words, that the base rules let pass.
MAX_REPEATED, MIN_WORDS = 30, 20
#: Rounds of labelling lines anew, gradient steps of a round, step size and weight decay of the fit.
ROUNDS, STEPS, RATE, RIDGE = 4, 60, 0.3, 1e-3


class Chains:
    """Chains of lines of similar length, padded: features, which places are lines, labels, weights."""

    def __init__(self, chains: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray):
        longest = max(map(len, chains))
        self.x = np.zeros((len(chains), longest, chains[0].shape[1]))
        self.on = np.zeros((len(chains), longest), bool)
        self.y = np.zeros((len(chains), longest), bool)
        for i, (c, y) in enumerate(zip(chains, labels)):
            self.x[i, : len(c)], self.on[i, : len(c)], self.y[i, : len(c)] = c, True, y
        self.weights = weights

    def likelihood(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted log-likelihood of the labels, its gradient, and each line's probability of being content."""
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        on, y, scale = self.on, self.y, self.weights / self.on.sum(axis=1)
        u = np.stack([np.zeros(on.shape), self.x @ w], axis=2)
        forward, backward = np.zeros(u.shape), np.zeros(u.shape)
        forward[:, 0] = u[:, 0]
        for t in range(1, on.shape[1]):
            step = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + u[:, t]
            forward[:, t] = np.where(on[:, t, None], step, forward[:, t - 1])
        for t in range(on.shape[1] - 2, -1, -1):
            after = u[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
            backward[:, t] = np.where(on[:, t + 1, None], step, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(np.minimum(0, forward[:, :, 1] + backward[:, :, 1] - total[:, None])) * on
        grad = np.zeros(len(theta))
        grad[:-4] = np.einsum("ij,ijk->k", (y * on - p) * scale[:, None], self.x)
        both = on[:, 1:] & on[:, :-1]
        value = (u[:, :, 1] * (y & on)).sum(axis=1) - total
        for a in (0, 1):
            for b in (0, 1):
                pair = forward[:, :-1, a] + moves[a, b] + u[:, 1:, b] + backward[:, 1:, b] - total[:, None]
                expected = np.exp(np.minimum(0, pair)) * both
                seen = both & (y[:, :-1] == a) & (y[:, 1:] == b)
                value += seen.sum(axis=1) * moves[a, b]
                grad[len(theta) - 4 + 2 * a + b] = ((seen - expected) * scale[:, None]).sum()
        return float((value * scale).sum()), grad, p


def relabelled(good: bool, path: np.ndarray, p: np.ndarray, words: np.ndarray, share: float) -> np.ndarray:
    """A chain's best path, with the least certain lines changed until its content share fits its text's label."""
    y = path.copy()
    content, all_ = int(words[y].sum()), int(words.sum())
    for i in np.argsort(-p if good else p, kind="stable"):
        if (content >= share * all_) == good:
            break
        if y[i] != good:
            y[i] = good
            content += int(words[i]) if good else -int(words[i])
    return y


@dataclass
class LineCrf:
    """Weights of features for label 1 (content) against 0, and transition weights."""

    weights: np.ndarray
    moves: np.ndarray

    @classmethod
    def empty(cls) -> LineCrf:
        """Without both classes to learn from, every line is content."""
        weights = np.zeros(len(S.LINE_FEATURES))
        weights[S.LINE_FEATURES.index("bias")] = 1.0
        return cls(weights, np.zeros((2, 2)))

    @classmethod
    def fit(cls, chains: list[np.ndarray], words: list[np.ndarray], labels: list[int], share: float = CONTENT_SHARE) -> LineCrf:
        """Maximum conditional likelihood with latent labels of lines; ``labels``: of the chains' texts, ``words``: of their lines.

        Each class weighs one half, and each chain of a class the same.
        """
        if len(set(labels)) < 2:
            return cls.empty()
        good = np.array(labels) == 1
        each = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
        order = np.argsort([len(c) for c in chains], kind="stable")
        parts = [p for p in np.array_split(order, 8) if len(p)]
        batches = [Chains([chains[i] for i in p], [np.full(len(chains[i]), good[i]) for i in p], each[p]) for p in parts]
        theta = np.zeros(chains[0].shape[1] + 4)
        model = cls.empty()
        for k in range(ROUNDS):
            square = np.full(len(theta), 1e-8)
            learnt = np.append(np.ones(len(theta) - 4), np.full(4, float(k > 0)))
            for _ in range(STEPS):
                grad = learnt * sum(b.likelihood(theta)[1] for b in batches) - RIDGE * theta
                square += grad**2
                theta = theta + RATE * grad / np.sqrt(square)
            model = cls(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())
            for part, batch in zip(parts, batches):
                p = batch.likelihood(theta)[2]
                for k, i in enumerate(part):
                    n = len(chains[i])
                    batch.y[k, :n] = relabelled(bool(good[i]), model.decode(chains[i]), p[k, :n], words[i], share)
        return model

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a chain of lines (Viterbi); content on ties."""
        gain = (x @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, gain[0], []
        for g in gain[1:]:
            to0, to1 = one + m10 >= zero + m00, one + m11 >= zero + m01
            zero, one = (one + m10 if to0 else zero + m00), (one + m11 if to1 else zero + m01) + g
            back.append((to0, to1))
        label = one >= zero
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1], bool)


def _sampled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in K.slices(batch.column(1)):
            w = K.words(s, lower=False)
            lines, unit = S.lines_with_words(s, w)
            x, words = S.line_features(s, w, lines, unit)
            cut = lines.bounds(s.n)
            starts = [(i, a) for i in range(s.n) for a in range(cut[i], cut[i + 1], SAMPLE_LINES)]
            ends = [min(cut[i + 1], a + SAMPLE_LINES) for i, a in starts]
            of = pa.array([s.first + i for i, _ in starts], pa.int64())
            columns = [
                batch.column(0).take(of),
                batch.column(2).take(of),
                pa.array([int(a - cut[i]) for i, a in starts], pa.int64()),
                pa.array([x[a:b].ravel() for (_, a), b in zip(starts, ends)], pa.list_(pa.float64())),
                pa.array([words[a:b] for (_, a), b in zip(starts, ends)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "line", "x", "words"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS, share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> LineCrf:
    """A field fitted on at most ``sample`` texts of each class of ``labels.quality``.

    Texts are cut into chains of ``SAMPLE_LINES`` lines; of more than ``sample`` chains of a
    class those with the least hash are taken, wherever they stand in their text.
    """
    texts = labelled_sample(documents, labels, "quality", sample, id_col, text_col)
    chains = texts.mapInArrow(K.released(_sampled_lines), "doc_id long, label int, line long, x array<double>, words array<long>")
    least = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", "line"), "doc_id", "line")
    rows = chains.withColumn("k", F.row_number().over(least)).filter(F.col("k") <= sample).select("label", "x", "words").collect()
    return LineCrf.fit([np.array(r.x).reshape(len(r.words), -1) for r in rows], [np.array(r.words) for r in rows], [r.label for r in rows], share)


def judged(s: K.Slice, crf: LineCrf, share: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base failures, verdicts and content words of a slice's texts."""
    w = K.words(s, lower=False)
    lines, unit = S.lines_with_words(s, w)
    base = S.base_counts(s, w, lines)
    x, words = S.line_features(s, w, lines, unit)
    cut = lines.bounds(s.n)
    content = np.zeros(s.n, np.int64)
    for i in range(s.n):
        a, b = cut[i], cut[i + 1]
        if a < b:
            content[i] = words[a:b][crf.decode(x[a:b])].sum()
    n = base["n_words"]
    failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * n)
    return base, failed, ~failed & (content >= share * n), content


def _rule(crf: LineCrf, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                base, failed, kept, content = judged(s, crf, share)
                columns = [pa.array(v.astype(np.int64)) for v in (base["n_words"], base["word_chars"], base["n_symbols"], base["n_dup_lines"], base["n_repeat_words"])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), *columns, pa.array(failed), pa.array(kept), pa.array(content)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"],
                )

    return run


def quality_rules(documents: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text", crf: LineCrf | None = None) -> DataFrame:
    """Counts, base verdict, content words and ``kept`` for every row of ``documents``.

    A null or empty text has no words and fails the base rules. Repeated rows are
    judged each; an empty table gives no rows; other columns are ignored. Without
    labels of both classes only the base rules decide.
    """
    crf = crf or fit(documents, labels, share=share, id_col=id_col, text_col=text_col)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"
    return texts.mapInArrow(K.released(_rule(crf, share)), schema)


def keep_content(documents: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text", crf: LineCrf | None = None) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns; a filter without a shuffle."""
    crf = crf or fit(documents, labels, share=share, id_col=id_col, text_col=text_col)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(at)):
                yield batch.slice(s.first, s.n).filter(pa.array(judged(s, crf, share)[2]))

    return documents.mapInArrow(K.released(run), documents.schema)
